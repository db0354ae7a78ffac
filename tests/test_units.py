import pytest
from pyspark.sql import functions as F

from stratafin.operators import units as U

LABELS = {
    "млн руб.": ("RUB", 6), "т.р.": ("RUB", 3), "RUB x 1,000": ("RUB", 3), "$ mn": ("USD", 6), "млн. тг": ("KZT", 6), "USD m": ("USD", 6), "MRUB": ("RUB", 6), "k RUB": ("RUB", 3), "руб. (тыс.)": ("RUB", 3),
    "в рублях": ("RUB", 0), "mlrd RUB": ("RUB", 9), "€ mn": ("EUR", 6), "—": None, "н/д": None, "": None, None: None, "384": ("RUB", 3), "тыс. долл. США": ("USD", 3),
}
TEXTS = {
    "(в миллионах российских рублей, если не указано иное)": ("RUB", 6),
    "ЕДИНИЦА ИЗМЕРЕНИЯ ПО ОКЕИ: 384": ("RUB", 3),
    "Eдиница изме­рения по ОКЕИ： ３８３\nВыручка 5 млрд руб.": ("RUB", 0),
    "Единица измерения по 0КЕИ: 3B5": ("RUB", 6),
    "Настоящая отчётность представ-\nлена в российских рублях с округлением до ближайшей тысячи.": ("RUB", 3),
    "All amounts are shown in RUB'000.": ("RUB", 3),
    "(amounts are expressed in bi|lions of roubles)": ("RUB", 9),
    "Presentation currency: USD million": ("USD", 6),
    "Figures: roubles, thousands": ("RUB", 3),
    "(в миллионах казахстанских тенге)": ("KZT", 6),
    "Гарантии не превышают 20 млрд руб. и раскрыты в примечании 5.": None,
    "Сегмент принёс 31,9 млрд руб.": None,
    "The Board redeemed bonds of 78 thousand roubles.": None,
    "Comparative figures for 2021 were restated; 5 million roubles.": None,
}


def test_labels(spark):
    df = spark.createDataFrame([(k,) for k in LABELS], "x string")
    got = {r.x: (tuple(r.u) if r.u else None) for r in df.select("x", U.unit_in(F.col("x")).alias("u")).collect()}
    assert got == LABELS


@pytest.mark.parametrize(("label", "want"), [("Выручка: руб., млн / активы — USD'000", (("RUB", 6), ("USD", 3))), ("total assets KRUB, выручка — ₽", (("RUB", 0), ("RUB", 3))), ("тыс. руб.", (("RUB", 3), ("RUB", 3))), ("выручка тыс. руб.", (("RUB", 3), None))])
def test_label_by_field(spark, label, want):
    r = spark.createDataFrame([(label,)], "x string").select(U.label_unit(F.col("x"), "revenue"), U.label_unit(F.col("x"), "total_assets")).first()
    assert tuple(tuple(u) if u else None for u in r) == want


def test_statements(spark):
    df = spark.createDataFrame([(k, k, 1) for k in TEXTS], "doc_id string, text string, unit int").select("doc_id", "text")
    got = {r.doc_id: tuple(r.unit) for r in U.declared_units(df, "doc_id", "text").collect()}
    assert {k: got.get(k) for k in TEXTS} == TEXTS


def _facts(spark, rows):
    names = ["fact_id", "doc_id", "period_year", "strategy", "unit_label", "ingested_at", *U.FACTS, "currency"]
    kinds = "fact_id long, doc_id string, period_year int, strategy string, unit_label string, ingested_at int, " + ", ".join(f"{f} double" for f in U.FACTS) + ", currency string"
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds)


def test_common_units(spark):
    full = {f: 10.0 * (i + 1) for i, f in enumerate(U.FACTS)}
    rows = [
        {"fact_id": 1, "doc_id": "A", "period_year": 2020, "unit_label": "тыс. руб.", **full},
        {"fact_id": 1, "doc_id": "A", "period_year": 2020, "unit_label": "тыс. руб.", "ingested_at": 5, **full},
        {"fact_id": 2, "doc_id": "A", "period_year": 2020, "strategy": "plain", **{f: v / 1000 for f, v in full.items() if f != "capex"}},
        {"fact_id": 3, "doc_id": "B", "period_year": 2020, "unit_label": "USD million", "revenue": 2.0},
        {"fact_id": 4, "doc_id": None, "period_year": None, "unit_label": None, "revenue": 7.0, "total_assets": 0.0},
        {"fact_id": 5, "doc_id": "C", "period_year": 1900, "unit_label": "EUR million", "total_assets": 3.0},
    ]
    texts = spark.createDataFrame([("A", "(в тысячах российских рублей)", "z"), ("A", None, "z"), ("B", "5 млрд руб.", "z")], "doc_id string, text string, field string")
    rates = spark.createDataFrame([("USD", 2020, 70.0), ("EUR", 2020, 80.0)], "currency string, period_year int, rub_per_unit double")
    out = U.common_units(_facts(spark, rows), texts, rates)
    got = {(r.fact_id, r.field): (r.currency, r.scale, r.basis, r.value_mln_rub) for r in out.collect()}
    assert got[1, "revenue"] == ("RUB", 3, "text", pytest.approx(0.01))
    assert got[2, "revenue"] == ("RUB", 6, "text", pytest.approx(0.01))  # a thousandth of the linked record: propagated
    assert got[3, "revenue"] == ("USD", 6, "label", 140.0)
    assert got[4, "revenue"] == ("RUB", 6, "default", 7.0) and got[4, "total_assets"][3] == 0.0
    assert got[5, "total_assets"] == ("EUR", 6, "label", None)
    assert len(got) == out.count() == 8
    found = {tuple(r) for r in U.in_other_units(out).collect()}
    assert found == {(1, "revenue"), (1, "total_assets"), (3, "revenue"), (5, "total_assets")}
    assert U.common_units(_facts(spark, []), texts.limit(0), rates).count() == 0


def test_robust_line(spark):
    rows = [([1.0, 2.0, 3.0, 4.0, 5.0], [1000.0, 2000.0, 7.0, 4000.0, 5000.0], (5, 1000.0, 0.0)), ([1.0, 2.0, 4.0], [11.0, 12.0, 14.0], (3, 1.0, 10.0)), ([5.0, None], [10.0, 3.0], (1, 2.0, 0.0)), ([None], [1.0], (0, None, None))]
    df = spark.createDataFrame([(x, h) for h, x, _ in rows], "x array<double>, h array<double>")
    got = df.select(U.line_between(F.col("x"), F.col("h")).alias("l"), U.factor(F.col("x"), F.col("h")).alias("f")).collect()
    assert [(r.l.n, r.l.scale, r.l.offset) for r in got] == [w for *_, w in rows]
    assert [r.f for r in got] == [1000.0, None, None, None]  # an offset is no conversion; one field alone proves none


def test_label_reaches_a_record_a_thousand_times_larger(spark):
    full = {f: 10.0 * (i + 1) for i, f in enumerate(U.FACTS)}
    rows = [
        {"fact_id": 1, "doc_id": "A", "strategy": "structured", "unit_label": "млн руб.", **full},
        {"fact_id": 2, "doc_id": "A", "strategy": "plain", **{f: v * 1000 for f, v in full.items()}},
        {"fact_id": 3, "doc_id": "B", "strategy": "structured", "unit_label": "тыс. руб.", **full},
        {"fact_id": 4, "doc_id": "B", "strategy": "plain", **full},  # a factor of one: the rule for no label holds
    ]
    kept = U.in_other_units(U.common_units(_facts(spark, rows), *_context(spark)))
    assert {r.fact_id for r in kept.collect()} == {3}  # the stated rule: no label, million roubles
    out = U.common_units(_facts(spark, rows), *_context(spark), linked_labels=True)
    got = {(r.fact_id, r.field): (r.currency, r.scale, r.basis) for r in out.collect()}
    assert got[2, "revenue"] == got[2, "total_assets"] == ("RUB", 3, "link") and got[1, "revenue"] == ("RUB", 6, "label")
    assert got[4, "revenue"] == ("RUB", 6, "default")


def test_units_propagate_over_several_links_and_currencies(spark):
    a, b, c = U.FACTS[:4], U.FACTS[2:8], U.FACTS[6:]
    value = {f: 10.0 * (i + 1) for i, f in enumerate(U.FACTS)}
    rows = [
        {"fact_id": 1, "doc_id": "S", "period_year": 2020, "strategy": "structured", "unit_label": "тыс. руб.", **{f: value[f] for f in a}},
        {"fact_id": 2, "doc_id": "S", "period_year": 2020, "strategy": "plain", **{f: value[f] / 1000 for f in b}},  # shares no field with the third
        {"fact_id": 3, "doc_id": "S", "period_year": 2020, "strategy": "direct", **{f: value[f] * 1000 for f in c}, "revenue": 5.0},
        {"fact_id": 4, "doc_id": "T", "period_year": 2020, "strategy": "structured", "unit_label": "USD million", **value},
        {"fact_id": 5, "doc_id": "T", "period_year": 2020, "strategy": "plain", **{f: v * 70 for f, v in value.items()}},
    ]
    texts, rates = _context(spark, [("S", "(в тысячах российских рублей)"), ("T", "Presentation currency: USD million")])
    got = {(r.fact_id, r.field): (r.currency, r.scale) for r in U.common_units(_facts(spark, rows), texts, rates).collect()}
    assert got[1, "revenue"] == ("RUB", 3) and got[2, "total_assets"] == ("RUB", 6)
    assert got[3, "revenue"] == ("RUB", 0)  # by way of the second record
    assert got[4, "revenue"] == ("USD", 6) and got[5, "revenue"] == ("RUB", 6)


def _context(spark, texts=()):
    return spark.createDataFrame(list(texts), "doc_id string, text string"), spark.createDataFrame([("USD", 2020, 70.0), ("EUR", 2020, 80.0)], "currency string, period_year int, rub_per_unit double")


def test_statements_of_any_length(spark):
    texts = {
        "long": "Показатели отчёта, если прямо не указано иное в соответствующем разделе или примечании к настоящей годовой отчётности, приведены без округления в тысячах долларов США",
        "second": "Баланс представлен в примечании 5.\nЕдиница измерения: тыс. руб.",
        "sentence": "Показатели отчёта сопоставимы. Займы превысили миллиард рублей.",
        "blank": "Показатели отчёта\n\nмиллиард рублей",
        "very long": "Показатели отчёта " + "и так далее, " * 30000 + "в млн руб.",
        "short stops": "Единица измерения: млн. Долл. США",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: tuple(r.unit) for r in U.declared_units(df, "doc_id", "text").collect()}
    assert got == {"long": ("USD", 3), "second": ("RUB", 3), "very long": ("RUB", 6), "short stops": ("USD", 6)}


def test_all_statements_of_one_text_count(spark):
    gap = "\nНастоящая отчётность проверена в 2021 году. " + "Выручка выросла на 7 пунктов. " * 5
    texts = {
        "later": "Суммы приведены в 2021 году по видам." + gap + "Единица измерения: тыс. руб.",
        "more": "Единица измерения: млн руб." + gap + "All amounts in RUB thousand." + gap + "Figures are in thousands of roubles.",
        "tie": "Единица измерения: тыс. руб." + gap + "Единица измерения: млн руб.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: tuple(r.unit) for r in U.declared_units(df, "doc_id", "text").collect()}
    assert got == {k: ("RUB", 3) for k in texts}
