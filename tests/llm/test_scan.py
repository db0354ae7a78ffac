import pytest

from stratafin.llm import lexicon as X
from stratafin.llm import scan as S
from stratafin.llm.canonical import Canon

_RU = "выручка прибыль компании аудиторы обратили внимание сократилась ставки лимиты кратко долгосрочная задолженность и на по годом контроля стоимость основных средств отчёт".split()
_EN = "the auditors noted revenue profit terms borrowings short long term and main million".split()
WORDS = {("C", w): 90 for w in _RU} | {("L", w): 90 for w in _EN} | {("C", "на"): 4000, ("C", "сгавки"): 2}
LEX = S.Lexicon(WORDS)


@pytest.fixture(scope="module")
def sc():
    return S.Scan(Canon(WORDS))


@pytest.mark.parametrize(
    ("text", "want", "cut", "bad"),
    [
        ("при-\nбыль компании", "прибыль компании", True, False),
        ("при- быль компании", "прибыль компании", True, False),
        ("ауди¬\r\nторы обра–\n  тили".replace("\r", ""), "аудиторы обратили", True, False),
        ("сокра-\nти-\nлась ставка", "сократилась ставка", True, False),
        ("пр0- быль", "пр0- быль", False, False),
        ("Кратко- и долгосрочная", "Кратко- и долгосрочная", False, False),
        ("short- and long-\nterm", "short- and long-\nterm", False, False),
        ("при6ыль сгоимость", "прибыль стоимость", False, True),
        ("terrns of borrovvings, mi|lion", "terms of borrowings, million", False, True),
        ("на 1O5,3 и 4l", "на 105,3 и 41", False, True),
        ("9М2023 R5A Q4 RUB'000 2021-2022", "9М2023 R5A Q4 RUB'000 2021-2022", False, False),
        ("при быль", "прибыль", True, False),
        ("при\nбыль", "прибыль", True, False),
        ("прибылькомпании", "прибыль компании", False, False),
        ("за-\nдол-\nжен-\nно-\nсть и сто имость", "задолженность и стоимость", True, False),
        ("при-\n6ыль", "прибыль", True, True),
        ("прибыль\n\nбыль, при, быль", "прибыль\n\nбыль, при, быль", False, False),
        ("на прибыль по годом", "на прибыль по годом", False, False),
        ("Ромашка Ромашкапром", "Ромашка Ромашкапром", False, False),
        ("", "", False, False),
    ],
)
def test_repair(sc, text, want, cut, bad):
    assert sc.repair(text) == (want, cut, bad)


def test_any_cuts_of_a_word_are_closed(sc):
    import itertools

    word = "задолженность"
    for i, j, k in itertools.combinations(range(1, len(word)), 3):
        run = f"{word[:i]}-\n{word[i:j]}¬ {word[j:k]}-\n{word[k:]}"
        assert sc.repair(f"на {run} по") == (f"на {word} по", True, False)


def test_window_is_the_cheapest_of_all_readings(sc):
    """Every way to group the tokens, priced one by one, against the dynamic program."""
    import itertools

    for tokens in itertools.product(("при", "быль", "прибыль", "на", "ся"), repeat=4):
        gaps = ["-\n", " ", "-\n"]
        text = "".join(t + g for t, g in zip(tokens, [*gaps, ""]))
        prices = []
        for cuts in itertools.product((True, False), repeat=3):
            groups, price, ok = [[0]], 0.0, True
            for i, c in enumerate(cuts, 1):
                groups.append([i]) if c else groups[-1].append(i)
            for g in groups:
                if len(g) == 1:
                    price += sc.cost(sc.count(tokens[g[0]], "C")) + (S.OPEN if g[0] in (0, 2) else 0.0)
                    continue
                word, spaces = "".join(tokens[i] for i in g), sum(gaps[i] == " " for i in g[:-1])
                if not sc.count(word, "C") or (spaces and not sc._fragments([tokens[i] for i in g], "C")):
                    ok = False
                    break
                price += sc.cost(sc.count(word, "C")) + S.AT_SPACE * spaces + S.AT_MARK * (len(g) - 1 - spaces)
            if ok:
                prices.append((round(price, 6), len(groups)))
        said, cut, _ = sc.window(text, "C", False)
        assert len(S._TOKEN.findall(said)) in {n for p, n in prices if p == min(prices)[0]}


def test_skeleton_and_numbers():
    assert S.skeleton("Годовой отчёт 2021") == S.skeleton("Г0довой отчёг 2O21")
    assert S.page_number("- 7 -")[1] == 7 and S.page_number("Страница 3 из 9")[1] == 3 and S.page_number("с. l2")[1] == 12
    assert S.page_number(" " * 90 + "12" + " " * 9)[1] == 12
    for x in ("1 076", "12,5", "2021 год", "Page", "9 / 3", "Таблица 5"):
        assert S.page_number(x) is None


def test_paragraphs():
    text = "ЗАГОЛОВОК\nАудиторы обратили внимание на\nстоимость основных средств.\n\n| a | b |\n| c | d |"
    assert S.paragraphs(text) == "ЗАГОЛОВОК\nАудиторы обратили внимание на стоимость основных средств.\n\n| a | b |\n| c | d |"


def test_paragraph_hyphens():
    assert S.paragraphs("за 2021-\n2022 годы и long-\nterm, кратко-\nи долгосрочная часть") == "за 2021-2022 годы и long-term, кратко- и долгосрочная часть"


def _rows():
    rows = []
    for page in (1, 2, 3, 4):
        rows += [("blocks", page * 10, "D", page, 0, "АО «Ромашка». Отчёт о" if page != 3 else "АО «Ромашка». 0тчёт о\nвыручка на"), ("blocks", page * 10 + 1, "D", page, 1, "прибыль на" + " на" * page), ("blocks", page * 10 + 2, "D", page, 2, f"стр. {page + 4}")]
    rows += [("blocks", 91, "E", 1, 0, "контро-"), ("blocks", 92, "E", 2, 0, "ля прибыль"), ("blocks", 93, "E", 2, 1, "7"), ("blocks", 94, None, None, None, "при-\nбыль"), ("blocks", 95, "E", 3, 0, None), ("blocks", 96, "E", 3, 1, "")]
    rows += [("parser_result", 1, "p1", None, None, "[[PAGE:1]]\nШапка отчёта\nпри6ыль\n1\n\n[[PAGE:2]]\nШапка отчёта\nвыручка\n2")]
    return rows + rows[:3]


WANT = {("blocks", p * 10, "header") for p in (1, 2, 3, 4)} | {("blocks", p * 10 + 2, "pageno") for p in (1, 2, 3, 4)}
WANT |= {("blocks", 30, "misread"), ("blocks", 91, "hyphen"), ("blocks", 92, "hyphen"), ("blocks", 94, "hyphen")}
WANT |= {("parser_result", 1, k) for k in ("header", "misread", "pageno")}


def test_frame(spark):
    df = spark.createDataFrame([(*r, "x") for r in _rows()], "rec_table string, rec_id long, doc string, page int, block_no int, text string, noise string")
    got = [tuple(r) for r in S.find_noise(df, LEX).collect()]
    assert len(got) == len(set(got))
    assert set(got) == WANT
    done = {(r.rec_table, r.rec_id): r.text for r in S.repair_texts(df.dropDuplicates(["rec_table", "rec_id"]), LEX).collect()}
    assert done["blocks", 30] == "выручка на" and done["blocks", 12] == "" and done["blocks", 95] is None
    assert done["parser_result", 1] == "[[PAGE:1]]\nприбыль\n[[PAGE:2]]\nвыручка"
    assert S.find_noise(df.limit(0), LEX).count() == 0


def test_headers_of_any_length(spark):
    long = "АО «Ромашка». Годовой отчёт о стоимости основных средств " + "и так далее по годам " * 30 + "для компании"
    rows = [("blocks", 10 * p + i, "D", p, i, t) for p in range(1, 7) for i, t in enumerate((long if p != 4 else long.replace("отчёт", "0тчёт") + " прибыль на", "прибыль на " * p))]
    rows += [("blocks", 100 + p, "E", p, 0, f"Прибыль компании на {'прибыль ' * 20}{p * 'на '}") for p in range(1, 5)]  # only the beginning comes back
    rows += [("parser_result", 7, "p7", None, None, "\n\n".join(f"[[PAGE:{p}]]\n{long}\n" + "на " * p + "прибыль" for p in (1, 2, 3)))]
    df = spark.createDataFrame(rows, "rec_table string, rec_id long, doc string, page int, block_no int, text string")
    got = {(r.rec_table, r.rec_id) for r in S.find_noise(df, LEX).filter("noise = 'header'").collect()}
    assert got == {("blocks", 10 * p) for p in range(1, 7)} | {("parser_result", 7)}
    done = {(r.rec_table, r.rec_id): r.text for r in S.repair_texts(df, LEX).collect()}
    assert done["blocks", 40] == "прибыль на" and done["blocks", 10] == ""
    assert done["parser_result", 7] == "\n".join(f"[[PAGE:{p}]]\n" + "на " * p + "прибыль" for p in (1, 2, 3))


def test_only_what_is_noise_is_taken_away(spark):
    head, rows = "Шапка отчёта", []
    for p in (1, 2, 3, 4):  # the header's words stand in mid-page too, a number that is no page number at one foot
        rows += [("blocks", 10 * p, "D", p, 0, head), ("blocks", 10 * p + 1, "D", p, 1, head + "\nприбыль на"), ("blocks", 10 * p + 2, "D", p, 2, "прибыль " * p)]
    foot = ["5", "6", "2400", "8"]
    rows += [("parser_result", 1, "p1", None, None, "\n\n".join(f"[[PAGE:{p}]]\n{"на " * p}прибыль\n{foot[p - 1]}" for p in (1, 2, 3, 4)))]
    df = spark.createDataFrame(rows, "rec_table string, rec_id long, doc string, page int, block_no int, text string")
    done = {(r.rec_table, r.rec_id): r.text for r in S.repair_texts(df, LEX).collect()}
    assert done["blocks", 20] == "" and done["blocks", 21].startswith(head)
    assert done["parser_result", 1] == "\n".join(f"[[PAGE:{p}]]\n{'на ' * p}прибыль" + (" 2400" if p == 3 else "") for p in (1, 2, 3, 4))


def test_words_beyond_the_vocabulary_decide_alike(spark):
    """With a vocabulary of a few words the rest is looked up by joins, and nothing changes."""
    rows = _rows() + [("blocks", 200, "F", 1, 0, "ауди- торы обра-\nтили прибылькомпании, сгоимость 6 задол-"), ("blocks", 201, "F", 2, 0, "женнос- ть при быль")]
    df = spark.createDataFrame(rows, "rec_table string, rec_id long, doc string, page int, block_no int, text string")
    counts = spark.createDataFrame([(a, w, n) for (a, w), n in WORDS.items()], "alphabet string, word string, n long")
    few, none = S.Lexicon.of(counts, 12), S.Lexicon.of(counts, 0)
    assert 0 < len(few.words) <= 12 and few.rest.count() == len([n for n in WORDS.values() if n >= 4]) - len(few.words) and none.words == {}
    assert few.total == none.total == LEX.total - 2  # but for the rare word
    for lex in (few, none):
        assert {tuple(r) for r in S.find_noise(df, lex).collect()} == {tuple(r) for r in S.find_noise(df, LEX).collect()}
    once = df.dropDuplicates(["rec_table", "rec_id"])
    assert {tuple(r) for r in S.repair_texts(once, few).collect()} == {tuple(r) for r in S.repair_texts(once, LEX).collect()}
    assert X.variants("8ш5") == {"8ш5", "вш5", "bш5", "8шs", "вшs", "bшs"}


def test_words_cut_between_pages_are_whole_in_texts(spark):
    blocks = [(1, "E", 1, 0, "выручка контро-"), (2, "E", 1, 1, "стр. 1"), (3, "E", 2, 0, "АО «Ромашка»"), (4, "E", 2, 1, "ля, прибыль задолжен¬"), (5, "E", 3, 0, "ность"), (6, "E", 3, 1, "ставки долго-"), (7, "E", 4, 0, "и на")]
    parse = "[[PAGE:2]]\nвыручка контро¬\nстр. 2\n[[PAGE:3]]\nАО «Ромашка»\nля. прибыль сто-\nстр. 3\n[[PAGE:4]]\nАО «Ромашка»\nимость\nставки кратко-\n[[PAGE:6]]\nля прибыль"
    rows = [("blocks", *b) for b in blocks] + [("parser_result", 1, "p1", None, None, parse), ("parser_result", 2, "p2", None, None, "[[PAGE:1]]\nпри-\n[[PAGE:2]]\n6ыль на"), ("parser_result", 3, "p3", None, None, "[[PAGE:1]]\nсгои-\n[[PAGE:2]]\nмость на")]
    df = spark.createDataFrame(rows, "rec_table string, rec_id long, doc string, page int, block_no int, text string")
    done = {(r.rec_table, r.rec_id): r.text for r in S.repair_texts(df, LEX).collect()}
    assert done["blocks", 1] == "выручка контроля," and done["blocks", 4] == "прибыль задолженность" and done["blocks", 5] == ""
    assert done["blocks", 6] == "ставки долго-" and done["blocks", 7] == "и на"
    assert done["parser_result", 1] == "[[PAGE:2]]\nвыручка контроля.\n[[PAGE:3]]\nприбыль стоимость\n[[PAGE:4]]\nставки кратко-\n[[PAGE:6]]\nля прибыль"
    assert done["parser_result", 3] == "[[PAGE:1]]\nстоимость\n[[PAGE:2]]\nна"
