"""One form for texts that look the same.

Every word with a sign that may look like another (a letter of another alphabet,
a wide or styled form, a letter and its mark, an invisible character) is read,
as it stands, by a weighted automaton over a trie of the corpus's own words:
such signs are free, letters that are only near to look at cost one each where a
word mixes alphabets.  The cheapest spelling is taken, of equal ones the most
frequent.  A word the automaton does not reach, and whatever is no word (spaces,
digits, signs), goes by table: forms folded, marks composed, ignorables out, the
letters to the alphabet of those that have no twin, else to that of the text.
A word of twins only, in a text of the other alphabet (``c`` for ``с``), is
changed if its twin is ``OFTEN`` times as frequent in such texts.

Defined results: null stays null, empty stays empty; CR LF and CR become LF
(and are no difference); signs that look different (№, m², «», —) are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stratafin.llm import lexicon as X

#: How many times as frequent a twin must be for a whole word to be changed.
OFTEN = 10
_SPACE = {ord(c): " " for c in X.BLANKS}
_GONE = {ord(c): None for c in X.IGNORABLE}
_FORMS = "".join(map(chr, X.COMPATIBLE))
_ODD = re.compile(f"[{X.IGNORABLE}{_FORMS}]|[^\\W\\d_][\u0300-\u036f]")
#: Words with what may stand inside them; a word begins with a sign that is seen.
_TOKEN = re.compile(f"[^\\W_](?:[^\\W_]|[\u0300-\u036f{X.IGNORABLE}])*")
_ALL_TWINS = re.compile(f"[{''.join(X.TWINS)}]+")
_MEMO = 400_000


class Canon:
    """The canonical spelling of texts with one vocabulary; kept per worker."""

    def __init__(self, words: dict[tuple[str, str], int]):
        self.words = words
        self.trie = {a: X.Trie((w, n) for (b, w), n in words.items() if a == b) for a in "CL"}
        self.plain: dict[str, set[str]] = {"C": set(), "L": set()}

    def token(self, t: str, a: str) -> str:
        """Canonical spelling of one raw word in a text of alphabet ``a``."""
        odd = not t.isascii() and _ODD.search(t) is not None
        shown = table_form(t) if odd else t
        letters = [c for c in shown if c.isalpha()]
        kinds = {X.script(c) for c in letters} - {""}
        if len(kinds) == 1 and "G" not in kinds:
            own = kinds.pop()
            if own == a or len(letters) < len(shown) or not _ALL_TWINS.fullmatch(shown):
                found = [(n, s) for s, n in self.trie[own].zero_cost(t) if X.pure(s)] if odd else []
                return max(found)[1] if found else shown
            twin = "".join(X.TWINS[c].get(a, "") for c in shown)
            if len(twin) < len(shown) or self.words.get((a, twin.lower()), 0) < max(OFTEN, OFTEN * self.words.get((a, shown.lower()), 0)):
                return shown
            return twin
        if not kinds:
            return shown
        found = [(-cost, n, b == a, s) for b in "CL" for cost, s, n in self.trie[b].alike(t, 1 + len(letters) // 6) if X.pure(s)]
        if found:
            return max(found)[3]
        fixed = [X.script(c) for c in letters if c not in X.TWINS]
        main = max("CL", key=lambda s: (fixed.count(s), s == a))
        return "".join(X.TWINS.get(c, {}).get(main, c) for c in shown)

    def piece(self, p: str, a: str) -> str:
        """A run of signs between white space: its words by the automaton, the rest by table."""
        if p.isascii() or not _ODD.search(p):
            return _TOKEN.sub(lambda m: self.token(m.group(), a), p)
        out, i = [], 0
        for m in _TOKEN.finditer(p):
            out += [table_form(p[i : m.start()]), self.token(m.group(), a)]
            i = m.end()
        return "".join([*out, table_form(p[i:])])

    def text(self, text: str | None) -> str | None:
        """The canonical form; known plain pieces cost one set difference a text."""
        if not text:
            return text
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if not text.isascii() and _BLANK.search(text):
            text = text.translate(_SPACE)
        a = X.written_in(text)
        plain = self.plain[a]
        unknown = set(text.split()) - plain
        if not unknown:
            return text
        if len(plain) > _MEMO:
            plain.clear()
        changed = {}
        for p in unknown:
            got = self.piece(p, a)
            if got == p:
                if len(p) < 64:
                    plain.add(p)
            else:
                changed[p] = got
        if changed:
            text = _PIECE.sub(lambda m: changed.get(m.group(), m.group()), text)
        return text


def table_form(text: str) -> str:
    """Forms folded, ignorables out, marks composed."""
    return X.compose(X.fold_width(text).translate(_GONE))


_PIECE = re.compile(r"\S+")
_BLANK = re.compile(f"[{X.BLANKS}]")
_canons: dict[str, Canon] = {}


def worker_canon(name: str, words: dict[tuple[str, str], int]) -> Canon:
    if name not in _canons:
        _canons.clear()
        _canons[name] = Canon(words)
    return _canons[name]


def canonical_texts(df: DataFrame, text: str, words: dict[tuple[str, str], int], out: str = "canonical", only_changed: bool = False) -> DataFrame:
    """``df`` with ``out``: the canonical form of ``text``; optionally only rows it differs in.

    One narrow stage; the vocabulary (at most ``lexicon.VOCABULARY`` words) is
    broadcast, tries and memos are kept per worker.
    """
    shared, name = df.sparkSession.sparkContext.broadcast(words), X.fingerprint(words)
    keep = [c for c in df.columns if c != out]
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = worker_canon(name, shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            forms = [canon.text(t) for t in texts]
            if only_changed:
                rows = [i for i, (t, f) in enumerate(zip(texts, forms)) if t != f and t.replace("\r\n", "\n").replace("\r", "\n") != f]
                batch, forms = batch.take(pa.array(rows, pa.int64())), [forms[i] for i in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*keep, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep).mapInArrow(run, f"{kinds}, `{out}` string")
