"""Nested page records to related flat tables, by higher-order projection.

A record's JSON is read as a variant.  One fold per record walks it level by
level: each step turns the nodes of a level into rows and into the nodes of the
next level, attaching positions and the nearest enclosing node.  The number of
steps is the record's own bracket depth, so no depth is cut off.  ``flatten``
joins the levels and one ``inline`` per target table emits its rows; no Python
runs and only the records delivered more than once are shuffled.

Defined results: null, empty, blank or invalid JSON (also with text after the
value, or with one key twice in an object) has no rows; null pages and blocks
have none but keep their position; bare strings are blocks without a type;
columns of the input other than the key and the JSON are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.sources.tables import once

#: Outer keys the array of pages is looked for under, before any other key that holds an array.
OUTER_KEYS = ("pages", "structured")


def strict_variant(text: Column) -> Column:
    """The whole text as one JSON value, or null: a sentinel behind it shows that nothing follows."""
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"end":true}')))
    return F.when(F.try_variant_get(whole, "$.end", "boolean"), F.try_variant_get(whole, "$.v", "variant"))


def _as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_string(v: Column) -> Column:
    return F.substring(F.to_json(v), 1, 1) == '"'


def bracket_depth(text: Column) -> Column:
    """Deepest nesting of brackets outside of strings."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda acc: acc["most"])


def _node(v: Column, path: Column, parent: Column, in_array: bool) -> Column:
    return F.struct(v.alias("v"), path.alias("path"), parent.alias("parent"), F.lit(in_array).alias("arr"))


def _row(path: Column, parent: Column, value: Column, text: Column | None = None) -> Column:
    got = lambda k, kind: F.try_variant_get(value, f"$.{k}", kind)
    if text is None:
        fields = (got("type", "string"), got("content", "string"), got("y", "double"))
    else:
        fields = (F.lit(None).cast("string"), text, F.lit(None).cast("double"))
    return F.struct(path.alias("path"), parent.alias("parent"), *[f.alias(n) for f, n in zip(fields, ("type", "content", "y"))])


def _level(nodes: Column) -> Column:
    """The nodes of one level, each looked at once: what it is, and its path as a parent."""

    def opened(n: Column) -> Column:
        return F.struct(n.alias("n"), _as_array(n["v"]).alias("a"), _as_map(n["v"]).alias("m"))

    def judged(x: Column) -> Column:
        block = F.coalesce(F.map_contains_key(x["m"], F.lit("type")) | F.map_contains_key(x["m"], F.lit("content")), F.lit(False))
        own = F.when(block & ~x["n"]["arr"], F.concat(x["n"]["path"], F.lit(".0"))).otherwise(x["n"]["path"])
        bare = x["a"].isNull() & x["m"].isNull() & x["n"]["arr"] & F.coalesce(_is_string(x["n"]["v"]), F.lit(False))
        return F.struct(
            x["n"]["v"].alias("v"), x["n"]["parent"].alias("parent"), x["a"].alias("a"), x["m"].alias("m"), own.alias("own"), block.alias("block"), bare.alias("bare"),
            F.when(block, own).otherwise(x["n"]["parent"]).alias("above"),
        )

    return F.transform(F.transform(nodes, opened), judged)


def _children(x: Column) -> Column:
    in_array = F.transform(x["a"], lambda e, i: _node(e, F.concat(x["own"], F.lit("."), i.cast("string")), x["above"], True))
    in_object = F.transform(F.map_values(x["m"]), lambda e: _node(e, x["own"], x["above"], False))
    return F.coalesce(in_array, in_object, F.slice(F.array(_node(x["v"], x["own"], x["above"], True)), 1, 0))


def _emitted(x: Column) -> Column:
    text = F.try_variant_get(x["v"], "$", "string")
    both = F.when(x["block"], F.array(_row(x["own"], x["parent"], x["v"]))).when(x["bare"], F.array(_row(x["own"], x["parent"], x["v"], text)))
    return F.coalesce(both, F.slice(F.array(_row(x["own"], x["parent"], x["v"])), 1, 0))


def _walk(nodes: Column, depth: Column) -> Column:
    """All block rows below ``nodes``."""
    none = F.slice(F.transform(nodes, lambda n: _row(n["path"], n["parent"], n["v"])), 1, 0)

    def step(acc: Column, _: Column) -> Column:
        seen = F.transform(
            F.array(_level(acc["nodes"])),
            lambda level: F.struct(
                F.flatten(F.transform(level, _children)).alias("nodes"),
                F.concat(acc["rows"], F.flatten(F.transform(level, _emitted))).alias("rows"),
            ),
        )
        return F.get(seen, F.lit(0))

    start = F.struct(nodes.alias("nodes"), none.alias("rows"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), start, step, lambda acc: acc["rows"])


def unnest(df: DataFrame, key: str = "result_id", pages: str = "pages", at: str | None = "ingested_at") -> DataFrame:
    """(key, page_rows, block_rows): each record's pages and blocks as arrays of structs.

    ``at`` names the delivery time by which a re-delivered key is counted once
    (records delivered once are not moved for that); None takes every row of
    ``df`` as it is.
    """
    df = once(df.select(key, at, pages), key, at, pages) if at else df.select(key, pages)
    whole = strict_variant(F.col(pages))
    doubled = F.when(_is_string(F.col("_v")), F.try_variant_get(F.col("_v"), "$", "string"))
    df = df.filter(F.col(pages).isNotNull()).select(key, pages, whole.alias("_v"))
    df = df.select(key, F.col("_v"), F.coalesce(doubled, F.col(pages)).alias("_t"), doubled.isNotNull().alias("_d"))
    df = df.select(key, "_t", F.when(F.col("_d"), strict_variant(F.col("_t"))).otherwise(F.col("_v")).alias("_v"))
    outer = _as_map(F.col("_v"))
    arrays = F.filter(F.transform(F.map_values(F.col("_o")), _as_array), lambda a: a.isNotNull())
    named = [_as_array(F.try_element_at(F.col("_o"), F.lit(k))) for k in OUTER_KEYS]
    df = df.select(key, "_t", _as_array(F.col("_v")).alias("_a"), outer.alias("_o"))
    df = df.select(key, bracket_depth(F.col("_t")).alias("_n"), F.coalesce(F.col("_a"), *named, F.get(arrays, F.lit(0))).alias("_a"))

    def page(e: Column, i: Column) -> Column:
        got = lambda k, kind: F.try_variant_get(e, f"$.{k}", kind).alias(k)
        own = i.cast("string")
        return F.struct(own.alias("path"), got("page_number", "int"), got("method", "string"), got("confidence", "double"), got("char_count", "bigint"), got("error", "string"), e.alias("v"))

    listed = F.filter(F.transform(F.col("_a"), page), lambda p: ~F.is_variant_null(p["v"]))
    df = df.select(key, "_n", listed.alias("_p"))

    def below(p: Column) -> Column:
        inside = F.transform(_as_array(p["v"]), lambda e, i: _node(e, F.concat(p["path"], F.lit("."), i.cast("string")), p["path"], True))
        members = F.transform(F.map_values(_as_map(p["v"])), lambda e: _node(e, p["path"], p["path"], False))
        bare = F.array(_node(p["v"], F.concat(p["path"], F.lit(".0")), p["path"], True))
        return F.coalesce(inside, members, bare)

    blocks = _walk(F.flatten(F.transform(F.col("_p"), below)), F.col("_n"))
    return df.select(key, F.col("_p").alias("page_rows"), blocks.alias("block_rows"))


def _rows(records: DataFrame, key: str, rows: Column) -> DataFrame:
    """One row an element; by the outer form, since for the other the optimizer walks every record once more to see if there is one."""
    return records.select(key, F.inline_outer(rows)).filter("node_path IS NOT NULL")


def page_table(records: DataFrame, key: str = "result_id") -> DataFrame:
    """One row a page of ``unnest``'s result, with its scalar members."""
    flat = F.transform("page_rows", lambda p: F.struct(p["path"].alias("node_path"), *[p[c].alias(c) for c in ("page_number", "method", "confidence", "char_count", "error")]))
    return _rows(records, key, flat)


def block_table(records: DataFrame, key: str = "result_id") -> DataFrame:
    """One row a block, naming its parent and its page; the same path once."""
    flat = F.transform("block_rows", lambda b: F.struct(b["path"].alias("node_path"), b["parent"].alias("parent_path"), F.substring_index(b["path"], ".", 1).alias("page_path"), b["type"].alias("type"), b["content"].alias("content"), b["y"].alias("y")))
    return _rows(records, key, flat)


def node_table(records: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, node_path, parent_path, node_kind) of every page and block, each once.

    Only paths under one record can be equal, so they are made distinct inside
    the record's arrays, without a shuffle.
    """
    row = lambda path, parent, kind: F.struct(path.alias("node_path"), parent.alias("parent_path"), F.lit(kind).alias("node_kind"))
    pages = F.transform("page_rows", lambda p: row(p["path"], F.lit(""), "page"))
    blocks = F.array_distinct(F.transform("block_rows", lambda b: row(b["path"], b["parent"], "block")))
    return _rows(records, key, F.concat(pages, blocks))
