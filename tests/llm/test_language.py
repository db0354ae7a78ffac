import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafin.llm import language as L
from stratafin.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    return L.fit_languages(table(spark, SF, "documents"))


def test_packed_equals_plain_network():
    net = L.ByteNet(3)
    x, n = L.windows(["Выручка выросла на 10 %", "Revenue rose. " * 20])
    assert n.tolist() == [1, 5]
    z, _ = net._pool(x)
    p = L.softmax(np.maximum(z, 0) @ net.dense + net.shift)
    assert np.abs(np.exp(net.packed().log_probs(x)) - p).max() < 0.05


def test_label_forms(spark):
    given = {"ru": "ru", "RU": "ru", "ru-RU": "ru", " rus ": "ru", "en_GB": "en", "ger": "de", "xx": None, "und": None, "": None, "unknown": None, None: None, "de-Latn-DE": "de"}
    df = spark.createDataFrame([(k,) for k in given], "x string")
    assert {r.x: r.l for r in df.select("x", L.label_language(F.col("x")).alias("l")).collect()} == given


def test_decode_like_brute_force():
    import itertools

    rnd = np.random.default_rng(0)
    for _ in range(20):
        s = rnd.normal(0, 5, (4, len(L.LANGS)))
        paths = itertools.product(range(len(L.LANGS)), repeat=4)
        cost = lambda p: sum(s[i, k] for i, k in enumerate(p)) - L.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(cost(L.decode(s)) - max(map(cost, paths))) < 1e-9


def test_held_out_accuracy(spark, net):
    """Labels of rows the sample holds too are noisy; agreement of clean labels must be high."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter("doc_id > 1000 AND length(trim(text)) > 0")
    out = L.label_documents(docs, net).filter("seg_no = -1").join(docs.select("doc_id", L.label_language(F.col("lang")).alias("l")), "doc_id").filter("l IS NOT NULL")
    assert out.filter("l = lang").count() / out.count() > 0.9


def test_cases(spark, net):
    ru, en, kk = "Выручка компании выросла за отчётный период из-за роста спроса на рынках.", "The audit committee approved the revised budget because of weaker demand.", "Аудиторлар меншікті капитал елеулі бағалауларға тәуелді екенін атап өтті."
    rows = [
        (1, ru, "ru"), (2, ru, "en"), (2, ru, "en"), (3, f"{ru}\r\n\r\n{en}\r{kk}", "ru"), (4, None, "ru"), (5, "", None), (6, " \n ", None),
        (7, en * 400, None), (8, "### TABLE 1\n| Показатель | 2020 |\n| --- | --- |\n" + ru, "RU"), (None, en, "de"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, seg_no int")
    got = sorted((r.doc_id or 0, r.seg_no, r.lang) for r in L.wrong_labels(df, net).collect())
    assert got == [(0, -1, "en"), (2, -1, "ru"), (2, -1, "ru"), (3, 0, "ru"), (3, 1, "en"), (3, 2, "kk"), (7, -1, "en")]
    assert L.wrong_labels(df.limit(0), net).count() == 0
    assert all(0 < r.confidence <= 1 for r in L.label_documents(df, net).collect())


def test_headings_are_lines_of_their_own():
    assert L.table_starts(["# Heading", "# Überschrift", "| a |", "| b |", "text", "| c |", "| d |"]) == [0, 1, 4, 5]


def test_pooling_like_brute_force():
    import numpy as np

    net, rnd = L.ByteNet(), np.random.default_rng(1)
    x = L._CLASSES[rnd.integers(0, 256, (3, L.WINDOW)).astype(np.uint8)]
    z, places = net._pool(x)
    for i, (w, f) in enumerate(zip(L.WIDTHS, net.filters)):
        for r in range(3):
            sums = np.array([sum(f[k][x[r, j + k]] for k in range(w)) for j in range(L.WINDOW - w + 1)])
            assert np.allclose(z[r, i * L.FILTERS : (i + 1) * L.FILTERS], sums.max(0), atol=1e-5)
            assert np.allclose(sums[places[i][r], np.arange(L.FILTERS)], sums.max(0), atol=1e-5)
