import pytest
from pyspark.sql import functions as F

from stratafin.functions import jsons
from stratafin.functions import text as T


def run(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_number(spark):
    given = {"1 243 808": 1243808.0, "1243808,42": 1243808.42, "(1 234)": -1234.0, "(5%)": -5.0, "-5": -5.0, "1,234": 1.234, "1,234.56": None, "12,5%": 12.5, "(5)%": None, "-": None, "—": None, "": None, "1 234": 1234.0, "1 234": None, "12d": None, None: None}
    assert run(spark, T.number, list(given)) == list(given.values())


def test_numbers(spark):
    given = {
        "Выручка 100 90": [10090.0], "Выручка 12,5 11,0": [12.5, 11.0], "(1 234) (900)": [-1234.0, -900.0], "Прибыль -5": [5.0], "(прим. 5)": [], "0": [], "1,243,808": [1.243, 808.0], "2023 2022": [20232022.0], "": [], None: None,
    }
    assert run(spark, T.numbers, list(given)) == list(given.values())


def test_years_and_columns(spark):
    assert run(spark, T.years, ["2023г 2022 г. 2021", "12023 1999 2100", "2020 2020"]) == [[2022, 2021], [], [2020, 2020]]
    assert run(spark, T.columns, ["Выручка  1 000\t900 ", "  ", "a b"]) == [["Выручка", "1 000", "900"], [], ["a b"]]


def test_markup(spark):
    assert run(spark, T.strip_markup, ["a<br/>b&nbsp;&amp;lt;c&gt;  <B>x</B>", "1 < 2", None]) == ["a b &lt;c> x", "1 < 2", None]


def test_cells(spark):
    given = {"637469  180175": ["637469", "180175"], "127 658  (110 035)": ["127 658", "(110 035)"], "637 469 180 175": ["637 469 180 175"], "-5 | 12,5": ["5", "12,5"], "12 (3)": ["12", "(3)"]}
    assert run(spark, T.cells, list(given)) == list(given.values())


def test_grouped(spark):
    given = {"1234567": "1 234 567", "1234,5": "1 234.5", "(1.2.3)": "1.2.3", "1,234,567": "1,234,567", "123": "123", "(110 035)": "(110 035)", "": "", "1234.50": "1 234.50"}
    assert run(spark, T.grouped, list(given)) == list(given.values())


def test_other_numbers(spark):
    given = {"1.234,56": 1234.56, "1,234.56": 1234.56, "[5]": -5.0, "1,234": 1.234, "abc": None, " (1 000) ": -1000.0, None: None}
    assert run(spark, T.mixed_number, list(given)) == list(given.values())
    assert run(spark, T.display_number, [-1234.5, 1234567.891, None], "double") == ["-1 234,50", "1 234 567,89", "N/A"]


def test_chunks(spark):
    got = run(spark, lambda c: T.chunks(c, 6000), ["я" * 13000, "", None])
    assert [[len(x) for x in g] if g is not None else None for g in got] == [[6000, 6000, 1000], [], None]


def test_kinds_and_tables(spark):
    assert run(spark, T.block_kind, ["ИТОГО", "### TABLE 1\nx", "a | b", "Текст", "123"]) == ["heading", "table", "table", "text", "text"]
    assert run(spark, T.is_table_row, ["1 | 2", "---", "", "1a", " (5) "]) == [True, False, False, False, True]
    made = run(spark, lambda c: T.markdown_table(F.from_json(c, "array<array<string>>"), F.lit("### TABLE 1")), ['[["a","b"],["1",null]]', '[["x","y"]]', "[]"])
    assert made == ["\n### TABLE 1\n\n| a | b |\n| --- | --- |\n| 1 |  |", "\n### TABLE 1\n\n|  |  |\n| --- | --- |", ""]


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"a": 1}', {"a": "1"}), ('```json\n{"a": 1}\n```', {"a": "1"}), ('x {"a":1} y {"b":2}', {}), ('[{"a":1}]', {}), ('text [{"a":1}]', {}), ("", {}), ("junk", {}), ("{'a':1}", {}),
        ('{"a":null}', {"a": None}), ("5", {}), ('{"a":1}} junk', {}),
    ],
)
def test_tolerant_json(spark, reply, want):
    assert run(spark, jsons.object_in, [reply]) == [want]


def test_merged_maps(spark):
    df = spark.range(1).select(F.array(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"))
    assert df.select(jsons.merged(F.col("m"))).first()[0] == {"a": "1", "b": "3"}


def test_replies_that_are_lists(spark):
    given = {'[{"a": 1, "b": "x"}, {"a": 2}, 5]': {"a": "2", "b": "x"}, 'so: {"a": null} ok': {"a": None}, "[1, 2]": {}, '{"a": 1} and {"b": 2}': {}, "junk": {}, "": {}, None: {}}
    df = spark.createDataFrame([(k,) for k in given], "x string")
    assert {r.x: r.m for r in df.select("x", jsons.merged_value(F.col("x")).alias("m")).collect()} == given


def test_pretty(spark):
    import json

    given = ['{"я": [1, {"b": null}], "e": [], "o": {}}', '"s"', "nope", None]
    df = spark.createDataFrame([(k,) for k in given], "x string")
    assert [r[0] for r in df.select(jsons.pretty_json("x")).collect()] == [json.dumps(json.loads(given[0]), ensure_ascii=False, indent=2), '"s"', None, None]
    tables = spark.createDataFrame([([[["a"], ["1"]], [[None]], [["b"], ["2"]]],)], "t array<array<array<string>>>")
    assert tables.select(T.markdown_tables("t")).first()[0] == "\n### TABLE 1\n\n| a |\n| --- |\n| 1 |\n\n### TABLE 3\n\n| b |\n| --- |\n| 2 |"
