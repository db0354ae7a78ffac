import pytest
from pyspark.sql import functions as F

from stratafin.operators import nested
from stratafin.operators import ratios as R
from stratafin.operators import statements as S
from stratafin.plans import pipeline

LINES = ["Показатель  2023  2022", "Выручка  1 000  900", "Чистая прибыль  (50)  70", "Итого активы 5 000 4 500", "Внеоборотные активы  300  200", "Оборотные активы  700  650"]


def frame(spark, lines, doc="D"):
    return spark.createDataFrame([(doc, i, x) for i, x in enumerate(lines, 1)], "doc_id string, line_no long, line string")


def test_document(spark):
    facts = S.extract_facts(frame(spark, LINES)).first().asDict()
    assert {k: v for k, v in facts.items() if v is not None} == {"doc_id": "D", "revenue": 1000.0, "net_profit": -50.0, "total_assets": 50004500.0, "current_assets": 700.0}
    df = S.extract_facts(frame(spark, LINES))
    got = {r.metric: (r.status, r.display) for r in R.displayed(R.metrics(df)).collect()}
    assert got["net_margin"] == ("risk", "-5.00%") and got["roa"] == ("risk", "-0.00%") and got["asset_turnover"] == ("risk", "0.00")
    assert sum(v == ("na", "—") for v in got.values()) == 9
    assert R.coefficient_map(R.metrics(df)).first().coefficients == {"Рентабельность чистой прибыли": -5.0, "ROA": -0.0001, "Оборачиваемость активов": 0.0}
    assert [r.warning for r in R.warnings(df).orderBy("ord").collect()] == [R.MISSING.format("equity"), R.NO_LIABILITIES, R.NO_SALES_PROFIT]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["a 2023 2022"], [2023, 2022]), (["a 2023 2022"] * 2, []), (["a 2023 2022"] * 3, [2023, 2022]), (["a 2023 2022", "b 2024 2023"], [2024]), (["a 2023 2022", "page 5"], []),
    ],
)
def test_context(spark, lines, want):
    rows = S.with_year_context(frame(spark, [*lines, "last line"])).filter("line = 'last line'")
    assert rows.first().context == want


@pytest.mark.parametrize(("line", "years", "want"), [("Выручка  1 000  900", [2022, 2023], 900.0), ("Выручка  1 000  900", [], 900.0), ("Итого  10", [2023, 2022], 10.0), ("5  Выручка  100", [2023, 2022], 5.0), ("Выручка  —  90", [2023, 2022], 90.0), ("Выручка 100", [2023], None)])
def test_value_by_column(spark, line, years, want):
    df = spark.createDataFrame([(line, years)], "line string, y array<int>")
    assert df.select(S.value_by_column(F.col("line"), F.col("y"))).first()[0] == want


@pytest.mark.parametrize(("found", "years", "want"), [([2023.0, 100.0, 90.0], [2023, 2022], 100.0), ([7.0], [2022, 2023], 7.0), ([5.0, 6.0], [], 5.0), ([2023.0], [2023], 2023.0), ([], [2023], None)])
def test_value_by_year(spark, found, years, want):
    df = spark.createDataFrame([(found, years)], "n array<double>, y array<int>")
    assert df.select(S.value_by_year(F.col("n"), F.col("y"))).first()[0] == want


def test_lines_and_fallback(spark):
    blocks = spark.createDataFrame([("A", 1, 0, " x \r\n\n y"), ("A", 2, 0, None), ("B", 1, 0, " ")], "doc_id string, page_number int, block_no int, content string")
    texts = spark.createDataFrame([("A", "no"), ("B", "from text\n"), ("C", None)], "doc_id string, text string")
    got = [tuple(r) for r in S.structured_lines(blocks, "doc_id", fallback=texts).orderBy("doc_id", "line_no").collect()]
    assert got == [("A", 1, "x"), ("A", 2, "y"), ("B", 1, "from text")]


EDGES = [("ros", 0.15, "ok"), ("ros", 0.05, "warn"), ("ros", 0.049, "risk"), ("current_ratio", 1.5, "ok"), ("current_ratio", 1.0, "warn"), ("autonomy", 0.33, "warn"), ("leverage", 1.0, "ok"), ("leverage", 2.5, "warn"), ("leverage", -3.0, "ok"), ("dso", 45.0, "ok"), ("dso", 90.0, "warn"), ("dso", 91.0, "risk"), ("capex_revenue", 0.25, "ok"), ("capex_revenue", 0.4, "warn"), ("roe", None, "na")]


def test_status_edges(spark):
    rules = {r[0]: r[5:] for r in R.RATIOS}
    for key, value, want in EDGES:
        assert spark.range(1).select(R.status(F.lit(value).cast("double"), *rules[key])).first()[0] == want
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ("ok", "warn", "risk", "na")], "s string").select(R.status_sign(F.col("s"))).collect()] == ["🟢", "🟡", "🔴", "⚪"]


def test_exact_ties(spark):
    df = spark.createDataFrame([("A", 1, "current_ratio", 1.125, "раз"), ("A", 2, "dso", 44.5, "дни"), ("A", 3, "roa", 0.01005, "%"), ("A", 4, "roa", None, "%")], "doc_id string, ord int, metric string, value double, unit string")
    assert [r.display for r in R.displayed(df).orderBy("ord").collect()] == ["1.12", "44 дн.", "1.00%", "—"]


def test_zero_denominator_and_quick(spark):
    row = dict.fromkeys(S.FIELDS) | {"doc_id": "A", "current_assets": 10.0, "current_liabilities": 5.0, "revenue": 0.0, "net_profit": 1.0}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k == 'doc_id' else 'double'}" for k in row))
    got = {r.metric: r.value for r in R.metrics(df).collect()}
    assert got["net_margin"] is None and got["quick_ratio"] is None and got["current_ratio"] == 2.0
    assert R.facts_summary(df).first().summary == "revenue=0.0; net_profit=1.0; current_assets=10.0; current_liabilities=5.0"


def test_analysis(spark):
    few = ["Выручка 5", "Запасы 6", "Чистая прибыль 1"]
    more = ["Выручка 5", "Запасы 6", "Чистая прибыль 1", "Оборотные активы 9", "Собственный капитал 3"]
    docs = {"even": (few, few, few), "plain": (few, more, more), "direct": (few, few, more), "none": ([], [], None), "fall back": ([], few, None), "all": (more, few, None)}
    lines = lambda i: spark.createDataFrame([(d, n, x) for d, v in docs.items() for n, x in enumerate(v[i] or [], 1)], "doc_id string, line_no long, line string")
    files = spark.createDataFrame([(d, f"{d}.pdf") for d in docs], "doc_id string, file_name string")
    chosen = pipeline.strategies(files.select("doc_id"), lines(0), lines(1), lines(2))
    got = {r.doc_id: r for r in pipeline.analyze(chosen, files, "2026-01-01").collect()}
    scores = {d: tuple(r.parse_meta.details)[:5] for d, r in got.items()}
    assert scores == {"even": (3, 3, 3, 3, 3), "plain": (3, 5, 5, 3, 5), "direct": (3, 3, 5, 3, 3), "none": (0, 0, -1, 0, 0), "fall back": (3, 3, -1, 3, 3), "all": (5, 3, -1, 5, 3)}
    picked = {d: (r.parse_meta.strategy, r.parse_meta.line_count, r.parse_meta.details.candidate) for d, r in got.items()}
    assert picked == {"even": ("structured", 3, "structured"), "plain": ("plain", 5, "plain"), "direct": ("direct", 0, "direct"), "none": ("structured", 0, "structured"), "fall back": ("structured", 3, "structured"), "all": ("structured", 5, "structured")}
    r = got["none"]
    assert set(r.facts) == {None} and [m.status for m in r.metrics] == ["na"] * 12 and r.coefficients == {} and len(r.warnings) == 5
    assert got["plain"].facts.revenue == 5.0 and got["plain"].file_name == "plain.pdf" and r.parse_meta.processor == pipeline.PROCESSOR


def test_context_work_is_linear(spark):
    """Many headers in one document: the fold is made once, not once a line."""
    lines = [f"a {2000 + i % 90} {2001 + i % 90}" if i % 2 else "Выручка 5" for i in range(20000)]
    now, want = [], {}
    for i, x in enumerate(lines, 1):
        if i % 2 == 0:
            now = [y for y in (int(w) for w in x.split()[1:]) if y not in now]
        want[i] = now
    rows = S.with_year_context(frame(spark, lines)).select("line_no", "context").collect()
    assert {r.line_no: r.context for r in rows} == want


def test_record_lines_and_preview(spark):
    pages = '{"pages": [{"blocks": [{"content": "b1\\n b2 ", "type": "t", "rows": [{"content": "inner"}]}, {"content": null}]}, "bare\\nline", {"x": [{"content": "c"}, "s"]}]}'
    df = spark.createDataFrame([(1, pages), (2, "junk"), (3, None)], "result_id long, pages string")
    rows = S.record_lines(nested.unnest(df, at=None))
    assert [(r.result_id, r.line_no, r.line) for r in rows.orderBy("line_no").collect()] == [(1, i, x) for i, x in enumerate(["b1", "b2", "inner", "bare", "line", "c", "s"], 1)]
    assert S.preview_lines(rows, 2).count() == 2
