import pytest

from stratafin import session
from stratafin.sources import tables as T

ROWS = [(1, 5, "a", "x"), (1, 7, "b", "x"), (2, 5, "c", "x"), (3, 5, "d", "x"), (3, 5, "e", "x"), (3, None, "z", "x"), (None, 1, "n", "x"), (None, 2, "m", "x"), (4, 1, None, "x")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, at int, text string, _n string")


@pytest.mark.parametrize("bound", [T.REPEATED_KEYS, 1])
def test_once(spark, bound):
    df = frame(spark, ROWS)
    got = sorted(((r.id, r.text) for r in T.once(df, "id", "at", "text", bound=bound).collect()), key=str)
    assert got == sorted([(1, "b"), (2, "c"), (3, "e"), (None, "n"), (None, "m"), (4, None)], key=str)
    assert T.once(df.limit(0), "id", "at", bound=bound).count() == 0
    assert T.once(df.filter("id = 2"), "id", "at").columns == df.columns


def test_newest_ties_by_value(spark):
    for rows in (ROWS, ROWS[::-1]):
        got = {r.id: r.text for r in T.newest(frame(spark, rows).repartition(3), "id", "at").collect()}
        assert got == {1: "b", 2: "c", 3: "e", None: "m", 4: None}


def test_texts_delivered_once_are_not_moved(spark):
    plan = T.once(frame(spark, ROWS), "id", "at", "text")._jdf.queryExecution().executedPlan().toString()
    single = plan.split("SortAggregate")[0]
    assert "BroadcastHashJoin" in single and "hashpartitioning" not in single


def test_staged_tables_are_released(spark):
    df = session.stage(frame(spark, ROWS))
    assert df.count() == len(ROWS) and session.release_staged(spark) >= 1 and session.release_staged(spark) == 0


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
