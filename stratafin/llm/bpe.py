"""Corpus encoding with a public byte-level BPE vocabulary, as a transducer.

The merge table is compiled into a finite-state transducer that is
determinised lazily.  A sequence of tokens is the BPE encoding of its bytes
exactly if every token encodes to itself and no merge would cross the seam of
any two neighbours, so a nondeterministic machine only has to remember the last
token and a position in the vocabulary trie.  The deterministic state is the
set of such hypotheses; whatever all of them agree on is emitted at once, the
rest is pending and bounded by the longest token.

Defined results: null and empty text give an empty list; blank text is encoded
as it is; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public vocabularies; a parameter, its files are never copied here.
TOKENIZER_DIR = os.environ.get("STRATAFIN_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which a worker's memo of pieces (states) is emptied; bounds memory, not results.
MEMO_PIECES, MEMO_STATES = 400_000, 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> bytes:
    with open(os.path.join(folder or TOKENIZER_DIR, f"{name}.json"), "rb") as f:
        return f.read()


class MergeTransducer:
    """Encodes one pre-token at a time; see the module's text."""

    def __init__(self, vocabulary: bytes):
        model, alphabet = json.loads(vocabulary)["model"], byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.id_of: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            self.id_of[raw(token)] = i
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; single bytes have none
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, token
        for n, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair, made = (self.id_of[a], self.id_of[b]), self.id_of[a + b]
            self.merge.setdefault(pair, (n, made))
            if made not in self.rank:
                self.rank[made], self.parts[made] = n, pair
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for b, i in self.id_of.items():
            if len(b) > 1 and i not in self.rank:
                continue  # added strings that no merge makes
            at = 0
            for x in b:
                nxt = self.children[at].get(x)
                if nxt is None:
                    nxt = self.children[at][x] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                at = nxt
            self.token_at[at] = i
        self.whole: dict[int, bool] = {}
        self.seams: dict[tuple[int, int], bool] = {}
        self.start = (-1, (((), 0),))
        self.steps: dict[tuple, dict[int, tuple]] = {}

    def seam_holds(self, a: int, b: int) -> bool:
        """No merge crosses the seam of a and b: undo their merges from the latest on."""
        known = self.seams.get((a, b))
        if known is None:
            known = self.seams[a, b] = self._seam(a, b)
        return known

    def _seam(self, a: int, b: int) -> bool:
        rank, parts, merge = self.rank, self.parts, self.merge
        before = float("inf")  # a crossing merge below this rank would have come first
        while True:
            cross = merge.get((a, b))
            if cross is not None and cross[0] < before:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, parts[a][1]  # of equal merges the left one comes first
            else:
                before, b = rb + 0.5, parts[b][0]

    def encodes_to_itself(self, t: int) -> bool:
        known = self.whole.get(t)
        if known is None:
            known = True
            if t in self.parts:
                a, b = self.parts[t]
                known = self.encodes_to_itself(a) and self.encodes_to_itself(b) and self._last_merge(a, b, t)
            self.whole[t] = known
        return known

    def _last_merge(self, a: int, b: int, t: int) -> bool:
        # the seam of a and b may be crossed by the token's own merge only
        own = self.merge[a, b]
        self.merge[a, b] = (float("inf"), t)
        try:
            return self._seam(a, b)
        finally:
            self.merge[a, b] = own

    def step(self, state: tuple, byte: int) -> tuple:
        """(tokens emitted, next state); made on first use and kept."""
        row = self.steps.get(state)
        if row is None:
            if len(self.steps) > MEMO_STATES:
                self.steps.clear()
            row = self.steps[state] = {}
        got = row.get(byte)
        if got is None:
            got = row[byte] = self._step(state, byte)
        return got

    def _step(self, state: tuple, byte: int) -> tuple:
        last, hyps = state
        moved = []
        for pending, node in hyps:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            if self.children[nxt]:
                moved.append((pending, nxt))
            t = self.token_at[nxt]
            if t >= 0 and self.encodes_to_itself(t):
                prev = pending[-1] if pending else last
                if prev < 0 or self.seam_holds(prev, t):
                    moved.append(((*pending, t), 0))
        first = min((p for p, _ in moved), key=len)
        n = 0
        while n < len(first) and all(p[n] == first[n] for p, _ in moved):
            n += 1
        if n:
            last = first[n - 1]
        return first[:n], (last, tuple((p[n:], node) for p, node in moved))

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        state, out = self.start, []
        for x in piece:
            emitted, state = self.step(state, x)
            out.extend(emitted)
        out.extend(next(p for p, node in state[1] if node == 0))
        return tuple(out)


class _Pieces(dict):
    """Ids of a space-led piece of text, found on first use."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > MEMO_PIECES:
            self.clear()
        got = self.encode(" " + piece)
        if len(piece) < 64:
            self[piece] = got
        return got


class Encoder:
    """Text to ids and back with one vocabulary."""

    def __init__(self, vocabulary: bytes):
        self.fst = MergeTransducer(vocabulary)
        self.pretokens = regex.compile(PATTERN)
        self.ragged = regex.compile(r" (?=\s|[\x1c-\x1f]|$)")
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pieces = _Pieces(self._slow)

    def _slow(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        memo = self.memo
        for p in self.pretokens.findall(text):
            ids = memo.get(p)
            if ids is None:
                ids = self.fst.encode_bytes(p.encode("utf-8", "surrogatepass"))
                if len(p) < 64:
                    if len(memo) > MEMO_PIECES:
                        memo.clear()
                    memo[p] = ids
            out.extend(ids)
        return tuple(out)

    def parts(self, text: str) -> Iterable[tuple[int, ...]]:
        """Ids by piece. A space before a non-space always begins a pre-token, so
        text without ragged spaces splits there and each piece is looked up."""
        if self.ragged.search(text):
            return (self._slow(text),)
        first, *rest = text.split(" ")
        return chain((self._slow(first),), map(self.pieces.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text))) if text else 0

    def decode(self, ids: Iterable[int]) -> str:
        """Incremental: a state machine holds the bytes of an unfinished character."""
        machine, table = Utf8Machine(), self.fst.bytes_of
        return "".join(machine.feed(table[i]) for i in ids) + machine.finish()


class Utf8Machine:
    """Incremental UTF-8 decoding; malformed bytes become U+FFFD."""

    def __init__(self):
        self.need, self.low, self.high, self.code, self.held = 0, 0x80, 0xBF, 0, b""

    def feed(self, data: bytes) -> str:
        out = []
        i = 0
        while i < len(data):
            b = data[i]
            if not self.need:
                i += 1
                if b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b <= 0xDF:
                    self._await(1, b & 0x1F)
                elif 0xE0 <= b <= 0xEF:
                    self._await(2, b & 0x0F, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF)
                elif 0xF0 <= b <= 0xF4:
                    self._await(3, b & 0x07, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF)
                else:
                    out.append("�")
            elif self.low <= b <= self.high:
                i += 1
                self.code, self.need, self.low, self.high = self.code << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(chr(self.code))
            else:
                out.append("�")  # the byte is looked at again as a first one
                self._await(0, 0)
        return "".join(out)

    def _await(self, need: int, code: int, low: int = 0x80, high: int = 0xBF) -> None:
        self.need, self.code, self.low, self.high = need, code, low, high

    def finish(self) -> str:
        left = "�" if self.need else ""
        self._await(0, 0)
        return left


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """One per worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


#: Rows and characters of one Arrow batch handed back; long texts make small batches.
_ROWS, _IDS = 2000, 2_000_000


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", *, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids) of every row of ``df``; other columns are not read.

    One narrow stage without a shuffle; the vocabulary is broadcast once (a
    fixed file of under 2 MB).
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, lengths, flat = 0, [], []
            for i, t in enumerate(texts.to_pylist()):
                ids = enc.encode(t)
                lengths.append(len(ids))
                flat.extend(ids)
                if i + 1 - start >= _ROWS or len(flat) >= _IDS or i + 1 == len(texts):
                    offsets = np.zeros(len(lengths) + 1, np.int32)
                    np.cumsum(lengths, out=offsets[1:])
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(lengths)), lists], names=[key, "ids"])
                    start, lengths, flat = i + 1, [], []

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", *, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``df`` without its text, with each row's number of ids (0 for null and empty)."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder))
    keep = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            n = pa.array([enc.count(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], names=[*keep, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(text, *keep).mapInArrow(run, f"{kinds}{', ' if keep else ''}{out} bigint")


def decode_documents(df: DataFrame, key: str = "doc_id", ids: str = "ids", *, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text) of lists of ids: the inverse of ``encode_documents``; null gives null."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
