import pytest

from stratafin.llm import residue as R
from stratafin.sources.tables import table

GOOD = [
    "Снизить себестоимость на 34.5% путём объединения закупок.",
    "Страница 404-й ведомости не сходится с главной книгой; сверить остатки до конца месяца.",
    '["Access to the credit line is denied until covenants are met; renegotiate with Veloport."]',
    "**Рекомендации:**\n- Доход от JavaScript-разработки (направление Полётэнерго) вырос; закрепить ставку на следующий год.",
    "Поддерживать текущую ликвидность (норма > 1,81 и < 3) и ежемесячно обновлять прогноз платежей.",
]
BAD = [
    "Снизить себестоимость на {{ratio}} путём объединения закупок.",
    "Отложить капитальные вложения до восстановления [указать сумму] денежного потока.",
    "HTTP 429: Too Many Requests. Retry after 30 seconds.",
    "You need to enable JavaScript to run this app.",
    "Lorem ipsum, lorem ipsum, lorem ipsum.",
    '["Write off slow-moving inventories of about 12 million roubles.", "Your recommendation text goes here."]',
    '{"error": {"code": 503, "message": "model runner has stopped"}}',
]


@pytest.fixture(scope="module")
def judge(spark):
    return R.fit_judge(table(spark, "/root/testdata/sf0.1", "recommendations"), "recommendations", "doc_id", "rec_id")


def test_judge(judge):
    assert [x for x in GOOD if judge.text(x) >= R.REFUSE] == []
    assert [x for x in BAD if judge.text(x) < R.REFUSE] == []
    assert judge.text("") == 0 and judge.text("  \n ") == 0


def test_style_of_placeholder_never_seen(judge):
    assert judge.text("Снизить себестоимость на <<~ratio~>> путём объединения закупок.") >= R.REFUSE


def test_json_texts():
    assert R.json_texts('["a", {"k": "b", "n": 1, "l": ["c"]}]') == ["a", "b", "c"]
    assert R.json_texts("[Блок]") is None and R.json_texts("plain") is None and R.json_texts('["cut') is None


def test_unseen_hosts_and_families(spark):
    rows = R.validate(table(spark, "/root/testdata/sf0.1", "recommendations"), "recommendations", "doc_id", "rec_id").collect()
    n = {(r.family, r.refused): r.n for r in rows}
    share = lambda family: n.get((family, True), 0) / (n.get((family, True), 0) + n.get((family, False), 0))
    assert share("told") > 0.98 and share("none") < 0.005 and share("held out") > 0.6


def test_scores_do_not_depend_on_order(judge):
    texts = ["Ошибка 200", "Ошибка 500", "Ошибка 503: сервис недоступен", "Рост на 5 %", "Рост на 70 %"]
    fresh = lambda order: {t: R.Judge(judge.weights, judge.bias).score(t) if order is None else None for t in texts}
    alone = fresh(None)
    for order in (texts, texts[::-1]):
        j = R.Judge(judge.weights, judge.bias)
        assert {t: j.score(t) for t in order} == alone
    assert R.form("HTTP/1.1 503, 1453 и 12") == "HTTP/0.0 500, 0 и 0"


def test_same_output_under_any_partitioning(spark, judge):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(GOOD + BAD + ["Ошибка 200", "Ошибка 500"])], "rec_id long, recommendations string")
    outs = [sorted(map(tuple, R.judge_texts(df.repartition(n), judge, "recommendations").collect())) for n in (1, 5)]
    assert outs[0] == outs[1]


def test_phrases_alone_refuse_nothing():
    import numpy as np

    assert R.phrases_in(BAD[2]) and R.Judge(np.zeros(R.BUCKETS), -1.0).text(BAD[2]) < R.REFUSE
    assert R.learn([], np.array([], bool), np.array([]))[1] < 0


def test_frame(spark, judge):
    rows = [(1, GOOD[0], 1.0), (2, BAD[0], 1.0), (2, BAD[0], 1.0), (3, None, 1.0), (4, "", 1.0), (5, GOOD[1] + "\n" + "Продолжать. " * 20000 + BAD[2], 1.0)]
    df = spark.createDataFrame(rows, "rec_id long, recommendations string, residue double")
    got = R.judge_texts(df, judge, "recommendations").filter("residue >= 0.5")
    assert sorted(r.rec_id for r in got.collect()) == [2, 2, 5]
    assert R.judge_texts(df.limit(0), judge, "recommendations").count() == 0
