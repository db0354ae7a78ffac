import json

from stratafin.operators import nested


def brute(text):
    """Plain recursive reading of one record."""
    try:
        o = json.loads(text)
        o = json.loads(o) if isinstance(o, str) else o
    except (TypeError, ValueError):
        return set()
    if isinstance(o, dict):
        o = next((o[k] for k in nested.OUTER_KEYS if isinstance(o.get(k), list)), next((v for v in o.values() if isinstance(v, list)), None))
    out = set()

    def walk(o, path, parent, arr):
        if isinstance(o, dict):
            block = "type" in o or "content" in o
            own = path + ".0" if block and not arr else path
            if block:
                out.add((own, parent, "block"))
            for v in o.values():
                if isinstance(v, (dict, list)):
                    walk(v, own, own if block else parent, False)
        elif isinstance(o, list):
            for i, e in enumerate(o):
                walk(e, f"{path}.{i}", parent, True)
        elif isinstance(o, str) and arr:
            out.add((path, parent, "block"))

    for i, p in enumerate(o if isinstance(o, list) else []):
        if p is None:
            continue
        out.add((str(i), "", "page"))
        if isinstance(p, str):
            out.add((f"{i}.0", str(i), "block"))
        elif isinstance(p, dict):
            for v in p.values():
                if isinstance(v, (dict, list)):
                    walk(v, str(i), str(i), False)
        else:
            walk(p, str(i), str(i), False)
    return out


CASES = [
    None, "", "  ", "{", "[1,", '[{"a":1}] x', "5", '"x"', "null", "[]", "[null]", '["bare", null, 7, true, ["a", {"type": null}]]',
    '[{"page_number": 1, "blocks": [null, "s", {"type": "t", "content": "c", "y": 1.5}, {"children": [{"content": null, "caption": {"type": "x"}}]}]}]',
    '{"pages": [{"layout": {"blocks": {"type": "t", "rows": [["a", "b"], [{"content": "]]]["}]]}}}]}',
    '{"other": 1, "anything": [{"blocks": ["x"]}]}',
    json.dumps(json.dumps([{"blocks": [{"type": "t", "content": 'q"\\ {'}]}])),
    json.dumps([{"b": [[[[[[[[[[[[{"type": 1, "c": {"type": 2, "d": {"e": {"f": ["deep"]}}}}]]]]]]]]]]]]}]),
    json.dumps([{"blocks": [{"type": "t", "content": "long " * 20000}] * 300}]),
]


def test_like_plain_recursion(spark):
    rows = [(i, t, "clash") for i, t in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "result_id long, pages string, node_path string")
    got = [tuple(r) for r in nested.node_table(nested.unnest(df.distinct(), at=None)).collect()]
    assert sorted(got) == sorted((i, *x) for i, t in enumerate(CASES) for x in brute(t))


def test_tables_and_redelivery(spark):
    text = '[{"page_number": 3, "method": "m", "blocks": [{"type": "t", "content": "c", "y": 2}]}]'
    df = spark.createDataFrame([(1, text, 5), (1, text, 9), (2, None, 1)], "result_id long, pages string, ingested_at int")
    u = nested.unnest(df)
    assert [tuple(r) for r in nested.page_table(u).collect()] == [(1, "0", 3, "m", None, None, None)]
    assert [tuple(r) for r in nested.block_table(u).collect()] == [(1, "0.0", "0", "0", "t", "c", 2.0)]
    assert nested.node_table(nested.unnest(df.limit(0))).count() == 0
