import itertools
import unicodedata

import pytest

from stratafin.llm import canonical as K
from stratafin.llm import lexicon as X

WORDS = {("C", w): n for w, n in {"прибыль": 90, "с": 50, "отчёт": 40, "года": 30, "а": 40, "ооо": 20, "по": 9, "край": 9}.items()} | {("L", w): n for w, n in {"profit": 80, "a": 60, "revenue": 20, "table": 9}.items()}


@pytest.fixture(scope="module")
def canon():
    return K.Canon(WORDS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Пpибыль по отчёту", "Прибыль по отчёту"),
        ("ПPИБЫЛЬ", "ПРИБЫЛЬ"),
        ("при­бы​ль года", "прибыль года"),
        ("отчёт, край", "отчёт, край"),
        ("Revеnuе of ３１，５％", "Revenue of 31,5%"),
        ("выросла c прошлого года a также", "выросла с прошлого года а также"),
        ("a table of profit", "a table of profit"),
        ("№ 5, м², «текст» — 9М2023, IT-услуги, EBITDA R5A", "№ 5, м², «текст» — 9М2023, IT-услуги, EBITDA R5A"),
        ("нeизвестнoe cловo тут", "неизвестное слово тут"),
        ("proﬁt and 𝐏rofit, ℝevenue", "profit and Profit, Revenue"),
        ("при\ufe00быль\u115f и ￥５", "прибыль и ¥5"),
        ("при\u2800край", "при край"),
        ("kрай и чисtый kрaй", "край и чисtый край"),
        ("o\u0442чe\u0308т, ｏтчёт", "отчёт, отчёт"),
        ("№ ² ½ ™ ℃ …", "№ ² ½ ™ ℃ …"),
        ("a\r\nb\rc", "a\nb\nc"),
        ("", ""),
        (None, None),
    ],
)
def test_forms(canon, text, want):
    assert canon.text(text) == want
    assert canon.text(want) == want


def test_zero_cost_walk_like_brute_force():
    words = ["сор", "cop", "пол", "оса"]
    trie = X.Trie((w, 1) for w in words)
    for token in ("".join(p) for p in itertools.product("сcоopрaа", repeat=3)):
        same = lambda a, b: a == b or b in X.TWINS.get(a, {}).values()
        want = {w for w in words if all(same(a, b) for a, b in zip(token, w))}
        assert {s for s, _ in trie.zero_cost(token)} == want


def test_the_automaton_reads_raw_words():
    trie = X.Trie([("прибыль", 9), ("прибыли", 4)])
    raw = "П\u00adpи\u200bбы\ufe0fль"
    assert trie.alike(raw) == [(0, "Прибыль", 9)]
    near = X.Trie([("край", 9)])
    assert near.alike("kрай") == [] and near.alike("kрай", 1) == [(1, "край", 9)]
    assert X.Trie([]).alike("a") == [] and X.Trie([("a", 1)]).alike("") == []


def test_trie_like_brute_force():
    words = sorted({"".join(p) for n in (1, 2, 3) for p in itertools.product("аб\U0001d400", repeat=n)})
    trie = X.Trie((w, i + 1) for i, w in enumerate(words[::2]))
    for w in [*words, "", "в"]:
        node = trie.walk(trie.root, w)
        assert (node is not None) == any(x.startswith(w) for x in words[::2])
        assert (trie.count(node) if node else 0) == (words[::2].index(w) + 1 if w in words[::2] else 0)


def test_variants_come_out_equal(canon):
    plain = "Прибыль по отчёту за годы"
    variants = [plain.replace("о", "o"), plain.replace("ё", "ё"), plain.replace("и", "и\u200b"), plain.replace(" ", "\u2007"), plain.replace("р", "p").replace("ы", "ы\ufe0e")]
    assert {canon.text(v) for v in variants} == {canon.text(plain)}


def test_alphabet_of_a_text():
    assert [X.written_in(x) for x in ("с. 5", "p. 5", "12", "", "ｔｈｅ ｃｈａｎｇｅ и", "слово " * 50, "word № " * 50)] == ["C", "L", "L", "L", "L", "C", "L"]


def test_tables_are_consistent():
    assert not set(X.IGNORABLE) & set(X.SPACES)
    assert all(unicodedata.category(c) in ("Cf", "Mn") or c in "\u115f\u1160\u3164\uffa0" for c in X.IGNORABLE)
    assert all(len(X.fold_width(c)) >= 1 and c not in X.IGNORABLE for c in map(chr, X.COMPATIBLE))
    assert all(unicodedata.category(c) == "Zs" for c in X.SPACES)


def test_frame(spark):
    rows = [("blocks", 1, "Пpибыль"), ("blocks", 2, None), ("blocks", 3, ""), ("blocks", 4, "чистый\r\nтекст"), ("blocks", 1, "Пpибыль"), ("blocks", 5, "слово " * 50000 + "пpи")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "rec_table string, rec_id long, text string, canonical string").drop("canonical")
    counts = X.count_words(df, "text")
    assert {(r.alphabet, r.word): r.n for r in counts.collect()}["C", "слово"] == 50000
    assert X.vocabulary(counts, rare=1, size=1) == {("C", "слово"): 50000}
    same = spark.createDataFrame([("C", f"слово{i}", 7) for i in range(500)], "alphabet string, word string, n long")
    assert 300 < len(X.vocabulary(same, rare=1, size=400)) <= 400  # one class that does not fit is taken in part
    assert X.fingerprint({("C", "а"): 5, ("C", "б"): 6}) != X.fingerprint({("C", "а"): 6, ("C", "б"): 5})
    cut = spark.createDataFrame([("при-\nбыль и при\u200bбыль \xadпо - по кратко- и",)], "text string")
    assert {r.word for r in X.count_words(cut, "text").collect()} == {"и", "прибыль", "по", "кратко"}
    assert X.vocabulary(counts, rare=1, size=0) == X.vocabulary(counts.limit(0)) == {}
    assert len(X.vocabulary(counts, rare=1)) == counts.count()
    out = K.canonical_texts(df, "text", WORDS, only_changed=True)
    assert sorted(r.rec_id for r in out.collect()) == [1, 1, 5]
    assert {r.rec_id: r.canonical for r in K.canonical_texts(df, "text", WORDS).collect()}[2] is None
    assert K.canonical_texts(df.limit(0), "text", WORDS).count() == 0
