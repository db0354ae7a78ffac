import random

import pytest

from stratafin.llm import mixing as M


def test_pivot_keeps_tokens_and_expectations():
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 50) for _ in range(7)]
    probs = [rnd.random() for _ in range(7)]
    mean = [0.0] * 7
    for seed in range(4000):
        out, held, p = M.pivot(list(range(7)), sizes, probs, seed)
        total = sum(s * (p if i == held else x) for i, (s, x) in enumerate(zip(sizes, out)))
        assert abs(total - sum(s * q for s, q in zip(sizes, probs))) < 1e-6
        for i, x in enumerate(out):
            mean[i] += (p if i == held else x) / 4000
    assert max(abs(a - b) for a, b in zip(mean, probs)) < 0.04


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 50)
    monkeypatch.setattr(M, "FANIN", 3)


def test_mix(spark, small):
    rnd = random.Random(2)
    rows = [(i, "big", rnd.randint(1, 100), "x") for i in range(2000)] + [(5000 + i, "small", rnd.randint(1, 100), "x") for i in range(60)]
    rows += [(9001, None, 10, "x"), (9002, "untargeted", 10, "x"), (9003, "big", 0, "x"), (9004, "small", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copies string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("empty", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed = M.mix(docs, targets)
    got = {r.doc_id: r.copies for r in mixed.collect()}
    assert len(got) == mixed.count() and not set(got) & {9001, 9002, 9003, 9004}
    assert all(got[i] == 3 for i in range(5000, 5060)) and max(v for k, v in got.items() if k < 5000) == 1
    shares = {r.source: r for r in M.reached_shares(mixed, targets).collect()}
    whole = sum(r.n_tokens for r in shares.values())
    assert abs(shares["big"].n_tokens - whole * 7 / 9) <= 101 and shares["empty"].actual_share == 0
    assert {r.doc_id: r.copies for r in M.mix(docs, targets).collect()} == got
    short = {r.source: r for r in M.reached_shares(M.mix(docs, targets, total=1e9), targets).collect()}
    assert short["big"].n_docs == 2000 and short["big"].most_repeats == 1
    assert M.mix(docs.limit(0), targets).count() == 0
