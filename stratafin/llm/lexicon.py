"""Corpus vocabulary as a trie, and weighted edit automata that walk it.

Words are counted over all texts, each in the alphabet its text is written in,
without what invisible characters and cut marks leave of a word.  The counts are
pre-aggregated in every task and summed by word, so a frequent word costs one
row a task.  The ``VOCABULARY`` most frequent words go to the driver (a bound
that does not grow with the corpus).  The trie is an ordered array of words; a
node is a range of it, so a worker builds nothing.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafin.session import stage

#: Most words the vocabulary holds; fewest occurrences of a word in it.
VOCABULARY, RARE = 200_000, 4
#: Letters that look alike, each group written Latin, Cyrillic, Greek (blank: none).
ALIKE = (
    "aа ", "cс ", "eе ", "oоο", "pрρ", "xх ", "yу ", "sѕ ", "iі ", "jј ", "v ν", "hһ ", "qԛ ", "wԝ ", "ëё ", "ïї ",
    "AАΑ", "BВΒ", "CС ", "EЕΕ", "HНΗ", "IІΙ", "JЈ ", "KКΚ", "MМΜ", "N Ν", "OОΟ", "PРΡ", "SЅ ", "TТΤ", "XХΧ", "YУΥ", "Z Ζ", "ËЁ ", "ÏЇ ", "WԜ ", "QԚ ",
)
SCRIPTS = "LCG"
TWINS: dict[str, dict[str, str]] = {a: {s: b for s, b in zip(SCRIPTS, g) if b != " "} for g in ALIKE for a in g if a != " "}
#: Letters of two alphabets that are near to look at; each costs one, and only where a word mixes alphabets.
NEAR = ("kк", "mм", "tт", "bв", "hн", "nп", "uи", "rг")
_NEAR: dict[str, str] = {x: y for a, b in NEAR for x, y in ((a, b), (b, a))}
#: Characters without a width or look of their own.
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0" + "".join(map(chr, (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))))
#: Spaces other than the plain one, and signs that are blank.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BLANKS = SPACES + "\u2800"
TOKEN = re.compile(r"[^\W_]+")


def script(c: str) -> str:
    """L, C or G of a letter, blank for any other character."""
    if c.isascii():
        return "L" if c.isalpha() else ""
    o = ord(c)
    if 0x400 <= o < 0x530:
        return "C"
    if 0x370 <= o < 0x400 and c.isalpha():
        return "G"
    return "L" if o < 0x250 and c.isalpha() else ""


def written_in(text: str) -> str:
    """The alphabet most letters of a text are of, by the bytes that begin Cyrillic letters and those of ASCII letters."""
    if text.isascii():
        return "L"
    raw = text.encode("utf-8", "replace")
    if b"\xef" in raw:  # wide forms among others
        raw = fold_width(text).encode("utf-8", "replace")
    return "C" if sum(map(raw.count, _CYRILLIC_LEADS)) > len(raw.translate(None, _NO_LATIN)) else "L"


_CYRILLIC_LEADS = (b"\xd0", b"\xd1", b"\xd2", b"\xd3")
_NO_LATIN = bytes(x for x in range(256) if not (65 <= x <= 90 or 97 <= x <= 122))


def pure(word: str) -> bool:
    """All letters of one alphabet."""
    return word.isascii() or len({script(c) for c in word}) == 1


def count_words(texts: DataFrame, text: str) -> DataFrame:
    """(alphabet, word, n) of all lower-case words of one alphabet, over all rows of ``texts``.

    Invisible characters do not part a word; the two ends of a word at a cut
    mark before white space are no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {"C": Counter(), "L": Counter()}
        words: Counter = Counter()

        def settle() -> None:  # a piece is taken apart once, however often it stands
            for a, seen in pieces.items():
                for p, n in seen.items():
                    if not p.isascii() and _UNSEEN.search(p):
                        p = _UNSEEN.sub("", p)
                    for w in TOKEN.findall(p):
                        if w.isalpha():
                            words[a, w.lower()] += n
                seen.clear()

        def flush() -> pa.RecordBatch:
            rows = [(a, w, n) for (a, w), n in words.items() if pure(w)]
            words.clear()
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["alphabet", "word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    parts = t.split()
                    if "-" in t or "¬" in t or "–" in t or "‐" in t or "=" in t or "\xad" in t:
                        for i in [i for i, p in enumerate(parts) if p[-1] in MARKS and len(p) > 1][::-1]:
                            if parts[i + 1 : i + 2] == [] or parts[i + 1].lower() not in SUSPENDED:
                                del parts[i : i + 2]
                    pieces[written_in(t)].update(parts)
            if sum(map(len, pieces.values())) > 300_000:
                settle()
                if len(words) > 300_000:
                    yield flush()
        settle()
        yield flush()

    made = texts.select(text).mapInArrow(run, "alphabet string, word string, n bigint")
    return made.groupBy("alphabet", "word").agg(F.sum("n").alias("n"))


#: Marks at which a word is cut.
MARKS = "-¬–‐=\xad"
#: Words that follow a suspended compound, whose first part is a word.
SUSPENDED = {"и", "или", "and", "or", "und", "oder", "et", "ou", "та", "і", "және"}
_UNSEEN = re.compile(f"[{IGNORABLE}]")


def vocabulary(counts: DataFrame, size: int = VOCABULARY, rare: int = RARE, staged: bool = False) -> dict[tuple[str, str], int]:
    """The ``size`` most frequent words, or all that occur ``rare`` times.

    The classes of frequency (sixteen to a doubling) are counted first, so the
    driver gets a bounded result and no task sorts the vocabulary; of the class
    that does not fit as a whole a part is taken by a hash of the word.
    ``staged`` says that the counts are a table of words that are not rare.
    """
    counts = (counts if staged else stage(counts.filter(F.col("n") >= rare))).withColumn("k", F.floor(F.log2("n") * 16))
    classes = sorted(((r.k, r.c) for r in counts.groupBy("k").agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least, part = 0, -1, 1.0
    for k, c in classes:
        if total + c > size:
            least, part = k, (size - total) / c
            break
        total += c
    slot = F.pmod(F.xxhash64("alphabet", "word"), F.lit(1 << 20)) < int(part * 0.98 * (1 << 20))
    taken = (F.col("k") > int(least)) | ((F.col("k") == int(least)) & slot)
    got = counts.filter(taken).select("alphabet", "word", "n").toArrow()
    rows = sorted(zip(*(got.column(i).to_pylist() for i in range(3))), key=lambda r: (-r[2], r))
    return {(a, w): n for a, w, n in rows[:size]}


def beyond(counts: DataFrame, words: dict[tuple[str, str], int], rare: int = RARE) -> tuple[DataFrame | None, int]:
    """(the words that occur ``rare`` times and did not fit into the vocabulary, occurrences of all words).

    None where all fit. The rest is as large as the corpus makes it and stays
    distributed; what a record needs of it is looked up by a join.
    """
    often = counts.filter(F.col("n") >= rare)
    n, total = often.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n <= len(words):
        return None, total
    spark = counts.sparkSession
    held = spark.createDataFrame(list(words), "alphabet string, word string") if words else spark.createDataFrame([], "alphabet string, word string")
    return stage(often.join(F.broadcast(held), ["alphabet", "word"], "left_anti")), total


def variants(token: str, budget: int = 2) -> set[str]:
    """All strings a token may be a misreading of by at most ``budget`` confusions, itself too."""
    done, out = {(token, 0)}, {token}
    for _ in range(budget):
        more = set()
        for t, start in done:
            for i in range(start, len(t)):
                for width in (1, 2):
                    for meant in MISREAD.get(t[i : i + width], ()) if i + width <= len(t) else ():
                        more.add((t[:i] + meant + t[i + width :], i + len(meant)))
        out |= {t for t, _ in more}
        done = more
    return out


def fingerprint(words: dict[tuple[str, str], int]) -> str:
    """A name of a vocabulary by its content."""
    return xxhash.xxh128_hexdigest("\n".join(f"{a}{w} {n}" for (a, w), n in sorted(words.items())).encode("utf-8", "replace"))


class Trie:
    """Words in order, a node being the range of those with one beginning: (from, to, beginning)."""

    def __init__(self, words: Iterable[tuple[str, int]]):
        pairs = sorted(words)
        self.words, self.counts = [w for w, _ in pairs], [n for _, n in pairs]
        self.root = (0, len(pairs), "")
        self.longest = max(map(len, self.words), default=0)

    def step(self, node: tuple[int, int, str], c: str) -> tuple[int, int, str] | None:
        lo, hi, start = node
        start += c
        lo = bisect_left(self.words, start, lo, hi)
        if lo == hi or not self.words[lo].startswith(start):
            return None
        return lo, bisect_left(self.words, start[:-1] + chr(ord(start[-1]) + 1), lo, hi), start

    def count(self, node: tuple[int, int, str]) -> int:
        """How often the word that ends at a node occurs, 0 if none does."""
        lo, hi, start = node
        return self.counts[lo] if lo < hi and self.words[lo] == start else 0

    def walk(self, node: tuple[int, int, str] | None, text: str) -> tuple[int, int, str] | None:
        for c in text:
            node = node and self.step(node, c)
        return node

    def alike(self, token: str, budget: int = 0) -> list[tuple[int, str, int]]:
        """(cost, spelling, count) of the words that look like a raw token.

        Twins of a letter, wide and other compatible forms, marks that compose
        and ignorables cost nothing; near letters cost one each, up to ``budget``.
        """
        states = [(0, self.root, "")]
        for options in _arcs(token):
            after: dict[tuple, tuple] = {}
            for cost, node, done in states:
                for said, more in options:
                    if cost + more > budget:
                        continue
                    to = self.walk(node, said.lower())
                    if to is not None and after.get((to, done + said), (9,))[0] > cost + more:
                        after[to, done + said] = (cost + more, to, done + said)
            states = list(after.values())
            if not states:
                return []
        return [(cost, done, self.count(node)) for cost, node, done in states if self.count(node)]

    def zero_cost(self, token: str) -> list[tuple[str, int]]:
        """(spelling, count) of the words that look like the token at no cost."""
        return [(s, n) for _, s, n in self.alike(token)]

    def noisy(self, token: str, budget: int = 2) -> list[tuple[int, str, int]]:
        """(edits, word, count) of words the token may be a misreading of; each confusion costs one."""
        states, out = [(self.root, 0, 0)], []
        while states:
            node, i, cost = states.pop()
            if i == len(token):
                if n := self.count(node):
                    out.append((cost, node[2], n))
                continue
            if to := self.step(node, token[i]):
                states.append((to, i + 1, cost))
            if cost < budget:
                for width in (1, 2):
                    for meant in MISREAD.get(token[i : i + width], ()) if i + width <= len(token) else ():
                        if to := self.walk(node, meant):
                            states.append((to, i + width, cost + 1))
        return out


def _arcs(token: str) -> list[list[tuple[str, int]]]:
    """What each sign of a raw token may stand for, with its cost; ignorables stand for nothing."""
    out, i = [], 0
    shown = [c for c in token if c not in _IGNORED]
    while i < len(shown):
        j = i + 1
        while j < len(shown) and "\u0300" <= shown[j] <= "\u036f":
            j += 1
        sign = fold_width(unicodedata.normalize("NFC", "".join(shown[i:j])))
        twins = [] if len(sign) > 1 else [(x, 0) for x in TWINS.get(sign, {}).values() if x != sign]
        near = _NEAR.get(sign.lower(), "") if len(sign) == 1 else ""
        out.append([(sign, 0), *twins, *([(near.upper() if sign.isupper() else near, 1)] if near else [])])
        i = j
    return out


_IGNORED = frozenset(IGNORABLE)


#: What stands in a scan for what was printed, in lower case.
MISREAD: dict[str, tuple[str, ...]] = {
    "0": ("о", "o"), "8": ("в", "b"), "6": ("б",), "4": ("ч",), "3": ("з",), "1": ("i", "l"), "5": ("s",), "9": ("g",), "!": ("i", "l"), "|": ("l", "i"), "$": ("s",),
    "с": ("е",), "г": ("т",), "п": ("н", "л"), "н": ("и",), "и": ("ц",), "щ": ("ш",),
    "c": ("e",), "u": ("n",), "b": ("h",), "d": ("cl",), "rn": ("m",), "vv": ("w",), "ii": ("n",), "li": ("h",),
}
#: Letters that stand for digits in a scanned number.
DIGIT_LIKE = {"O": "0", "o": "0", "О": "0", "о": "0", "S": "5", "s": "5", "l": "1", "I": "1", "|": "1", "!": "1", "B": "8", "З": "3", "з": "3", "б": "6"}


def fold_width(text: str) -> str:
    """Full-width, half-width, styled and joined forms of letters and signs to plain ones."""
    return text.translate(COMPATIBLE)


def _compatible() -> dict[int, str]:
    """The plain form of every sign that is only another width or style of it, by the tags of its decomposition.

    Signs that look different (№, ², ½, ™) carry other tags and stay.
    """
    out = {0x3000: " "}
    for first, last in ((0x2100, 0x214F), (0xFB00, 0xFB06), (0xFF01, 0xFFEE), (0x1D400, 0x1D7FF)):
        for o in range(first, last + 1):
            tag = unicodedata.decomposition(chr(o)).partition(" ")[0]
            if tag in ("<wide>", "<narrow>", "<font>") or (tag and tag[0] != "<") or 0xFB00 <= o <= 0xFB06:
                out[o] = unicodedata.normalize("NFKC", chr(o))
    return {o: s for o, s in out.items() if chr(o) not in IGNORABLE}


COMPATIBLE = _compatible()


def compose(text: str) -> str:
    """Letters and combining marks to composed letters where they exist; other characters stay."""
    return _MARKED.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)


_MARKED = re.compile(r"[^\W\d_][\u0300-\u036f]+")
