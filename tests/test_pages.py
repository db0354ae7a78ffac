from pyspark.sql import functions as F

from stratafin.operators import arbitration as A
from stratafin.operators import layout as L
from stratafin.operators import pages as P
from stratafin.operators import ratios as R
from stratafin.operators import report as O
from stratafin.operators.statements import FIELDS


def test_reading_order_and_lines(spark):
    rows = [("D", 1, 0, 100.0, 50.0, "A"), ("D", 1, 1, 101.0, 120.0, "B"), ("D", 1, 2, 102.0, 200.0, "C"), ("D", 1, 3, 120.0, 50.0, "D"), ("D", 1, 4, None, None, "X"), ("D", 1, 5, None, None, "Y")]
    df = spark.createDataFrame(rows, "doc_id string, page_number int, pos int, y double, x double, text string")
    lines = L.group_lines(L.reading_order(df, ["doc_id", "page_number"]), ["doc_id", "page_number"])
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["A  B", "C", "D", "X", "Y"]


def test_box(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 6.0]]), (2, None), (3, [[1.0]]), (4, [])], "i int, p array<array<double>>")
    got = [r.b for r in df.select("i", L.box_position(F.col("p")).alias("b")).orderBy("i").collect()]
    assert tuple(got[0]) == (4.0, 1.0) and got[1:] == [None, None, None]


def test_table_repair(spark):
    text = "Баланс  на 31  декабря\n637469  180175\n127 658  (110 035)\nитог\n5\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "a  b")], "i int, text string")
    got = {r.i: r.text for r in L.repair_tables(df, ["i"]).collect()}
    assert got[1] == "Баланс на 31 декабря\n        637 469 |         180 175\n        127 658 |       (110 035)\nитог\n5\n"
    assert got[2] == "" and got[3] == "a  b"


def _candidates(spark):
    rows = [("D", 1, "surya_ocr", "x", 0.7), ("D", 1, "pdfplumber", "y", 0.9), ("D", 2, "surya_ocr", "x", 0.69), ("D", 2, "pymupdf", "z", 0.75), ("D", 3, "pdfplumber", " ", 0.1), ("D", 4, "other", "### TABLE 1 ### TABLE 2", 0.5)]
    return spark.createDataFrame(rows, "doc_id string, page_number int, method string, text string, confidence double")


def test_pages(spark):
    pages = P.resolve_pages(_candidates(spark))
    assert [(r.page_number, r.method, r.extracted) for r in pages.orderBy("page_number").collect()] == [(1, "surya_ocr", True), (2, "pymupdf", True), (3, "fallback", False), (4, "other", True)]
    s = P.page_summary(pages).first()
    assert (s.total_pages, s.extracted_pages, s.coverage_percent, s.total_tables, s.avg_confidence) == (4, 3, 75.0, 2, 0.65)
    assert [r.page_number for r in P.missing_pages(pages).collect()] == [3]
    assert P.resolve_pages(_candidates(spark), max_pages=1).count() == 1
    assert P.joined_pages(pages).first().text.startswith("[[PAGE:1]]\nx\n\n[[PAGE:2]]\nz\n\n[[PAGE:3]]\n\n\n[[PAGE:4]]\n")


def test_ranking(spark):
    rows = [("D", 1, "Выручка и собственный капитал"), ("D", 2, "выручка; вознаграждение"), ("D", 3, "Капитал"), ("D", 4, "капитал"), ("D", 5, "нет")]
    ranked = P.rank_pages(spark.createDataFrame(rows, "doc_id string, page_number int, text string"), k=2)
    assert [(r.page_number, r.score) for r in ranked.orderBy("rank").collect()] == [(1, 3), (3, 1)]
    assert P.relevant_text(ranked).first().text == "выручка и собственный капитал" + P.PAGE_BREAK + "капитал"


def test_strategies(spark):
    def pick(*scores):
        rows = [("D", s, *[1.0 if i < n else None for i in range(len(FIELDS))]) for s, n in zip(A.STRATEGIES, scores) if n is not None]
        return A.pick_strategy(spark.createDataFrame(rows, "doc_id string, strategy string, " + ", ".join(f"{f} double" for f in FIELDS))).first().strategy

    assert [pick(3, 3, 3), pick(3, 4, 4), pick(3, 3, 4), pick(0, 0, None)] == ["structured", "plain", "direct", "structured"]


def test_first_last_distinct(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, None), ("b", 1, None)], "k string, at int, v string")
    assert [tuple(r) for r in A.first_known(df, ["k"], "v", "at").collect()] == [("a", "x")]
    assert [tuple(r) for r in A.last_known(df, ["k"], "v", "at").collect()] == [("a", "y")]
    assert {tuple(r) for r in A.distinct_in_order(df, "v", "at").collect()} == {(None, 1), ("x", 2), ("y", 3)}


def test_recommendations(spark):
    given = {"plain": "plain", '["a","b"]': "a\nb", '[{"параметр":"ROA","рекомендация":"x","значение":"","норма":"> 1"},{"рекомендация":"y"}]': "1. ROA\n   Рекомендация: x\n   Норма: > 1\n\n2. Рекомендация 2\n   Рекомендация: y\n", "[1": "[1", None: None}
    df = spark.createDataFrame([(k,) for k in given], "r string")
    assert {r.r: r.t for r in df.select("r", O.recommendation_text(F.col("r")).alias("t")).collect()} == given


def test_report_and_preview(spark):
    facts = {f: None for f in FIELDS} | {"revenue": 10.0, "net_profit": 1.0, "total_assets": 100.0, "equity": 50.0, "profit_from_sales": 1.0, "current_assets": 5.0}
    rows = [("D", "f.pdf", "2026-01-01", "a <b>\n\n c&d", *facts.values()), ("E", "g.pdf", "2026-01-01", None, *[None] * 12)]
    reports = spark.createDataFrame(rows, "doc_id string, file_name string, date string, text string, " + ", ".join(f"{f} double" for f in FIELDS))
    got = {(r.doc_id, r.section, r.ord): " ".join(r.cells) for r in O.report_rows(reports, "text").collect()}
    assert [got["D", *k] for k in ((1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 3), (5, 0), (5, 1), (5, 2))] == [O.TITLE, "Файл: f.pdf", "Дата: 2026-01-01", "Предупреждения", f"• {R.NO_LIABILITIES}", "Статус Показатель Значение Формула", "🟡 ROA 1.00% Чистая прибыль / Активы".replace("🟡", R.SIGNS["risk"]), "Рекомендации", "a &lt;b&gt;", "c&amp;d"]
    assert len(got) == 4 + 2 + 12 + 3 + 4 + 6 + 12 and ("E", 5, 0) not in got and got["E", 4, 12].startswith("⚪ CAPEX")
    metrics = spark.createDataFrame([("D", 1, "roa", "ROA", "a / b", "1.00%", "ok")], "doc_id string, ord int, metric string, title string, formula string, display string, status string")
    preview = O.with_balance_first(metrics)
    assert [r.title for r in preview.orderBy("ord").collect()] == ["Баланс", "ROA"] and O.with_balance_first(preview).count() == 2


def test_which_layer_a_page_is_read_by(spark):
    rows = {1: [("surya_ocr", 0.78), ("pymupdf", 0.75)], 2: [("surya_ocr", 0.78)], 3: [("pymupdf", 0.75), ("other", 0.8)], 4: [("pdfplumber", 0.9), ("other", 0.99)], 5: [("surya_ocr", 0.81), ("pdfplumber", 0.9)], 6: [("pymupdf", 0.0)]}
    df = spark.createDataFrame([("D", p, m, "t", c) for p, v in rows.items() for m, c in v], "doc_id string, page_number int, method string, text string, confidence double")
    got = {r.page_number: (r.method, r.extracted) for r in P.resolve_pages(df, 0.8).collect()}
    assert got == {1: ("pymupdf", True), 2: ("fallback", False), 3: ("other", True), 4: ("pdfplumber", True), 5: ("surya_ocr", True), 6: ("fallback", False)}


def test_page_read_by_itself(spark):
    items = [("D", 1, 100.0, 50.0, "A"), ("D", 2, 104.0, 300.0, " B "), ("D", 3, 120.0, 5.0, "C<br>d"), ("D", 4, None, None, "x"), ("D", 5, None, None, "y"), ("D", 6, 119.0, 9.0, " ")]
    df = spark.createDataFrame(items, "doc_id string, pos int, y double, x double, text string")
    assert L.single_page_text(df, ["doc_id"]).first().text == "A B\nC d\nx\ny"
