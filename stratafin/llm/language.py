"""Languages of documents and of the lines of mixed documents, by a byte network.

A convolutional network reads fixed windows of bytes: filters of several widths,
max pooling over the window, a softmax layer.  It is trained in numpy on a
bounded sample of labelled documents (``SAMPLE`` rows, ordered by a hash of the
id) whose labels may be partly wrong: later rounds leave out windows whose label
the round before did not believe.  For use, a pair of
neighbouring bytes is one index into a table of 8-bit sums, so that a filter of
width six costs three look-ups.

A document's lines are decoded together: every line has the summed log
probabilities of its windows, and changing the language between lines costs
``SWITCH``.  The lines of one table share a language; other neighbouring lines
do unless their own text speaks clearly against it.

Defined results: null, empty and blank texts have no rows; a text without
letters gets the likeliest language with low confidence; lines end at LF, CR or
CR LF; non-blank lines are numbered from 0; repeated rows are labelled each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages and their two- and three-letter codes.
CODES = {
    "ru": ("ru", "rus"),
    "en": ("en", "eng"),
    "uk": ("uk", "ukr"),
    "kk": ("kk", "kaz"),
    "de": ("de", "deu", "ger"),
    "fr": ("fr", "fra", "fre"),
}
LANGS = tuple(CODES)
#: Bytes of a window; filter widths (in bytes, even) and filters of each width.
WINDOW, WIDTHS, FILTERS = 64, (2, 4, 6, 8, 10), 16
#: Labelled documents the network is fitted on, and windows taken from one of them.
SAMPLE, WINDOWS_A_DOC = 6000, 12
#: Further rounds of fitting, each without windows whose label the last one gave at most this probability.
ROUNDS, DOUBT = 2, 0.3
#: Cost of a change of language between lines, in nats; evidence a language needs to make a text mixed.
SWITCH, EVIDENCE = 6.0, 5.0
_LINE = re.compile(r"\r\n|\n|\r")


def label_language(label: Column) -> Column:
    """The language a label names, null if it names none of them."""
    code = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_][a-z0-9]*)*$", 1)
    out = F.lit(None).cast("string")
    for lang, names in CODES.items():
        out = F.when(code.isin(*names), lang).otherwise(out)
    return out


def _classes() -> np.ndarray:
    """Bytes as the network sees them: ASCII in lower case, digits alike, white space alike."""
    c = np.arange(256, dtype=np.uint8)
    c[65:91] += 32
    c[48:58] = 48
    c[[9, 10, 11, 12, 13]] = 32
    return c


_CLASSES = _classes()


def lines_of(text: str) -> list[str]:
    return [x for x in _LINE.split(text) if x.strip()]


def windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, number of windows of each line); the last window of a line is padded."""
    raw = [x.encode("utf-8", "replace") for x in lines]
    n = np.array([-(-len(x) // WINDOW) for x in raw], np.int64)
    data = b"".join(x.ljust(int(k) * WINDOW, b"\0") for x, k in zip(raw, n))
    return _CLASSES[np.frombuffer(data, np.uint8).reshape(-1, WINDOW)], n


class ByteNet:
    """Filters of several widths over bytes, max pooling, softmax."""

    def __init__(self, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.filters = [rnd.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        size = FILTERS * len(WIDTHS)
        self.bias = np.zeros(size, np.float32)
        self.dense = rnd.normal(0, 0.2, (size, len(LANGS))).astype(np.float32)
        self.shift = np.zeros(len(LANGS), np.float32)

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pooled, places = [], []
        cols = np.ascontiguousarray(x.T)  # places first, so that sums and maxima run over whole rows of the batch
        for w, f in zip(WIDTHS, self.filters):
            n = WINDOW - w + 1
            conv = f[0].take(cols[:n], axis=0)
            for k in range(1, w):
                conv += f[k].take(cols[k : k + n], axis=0)
            best = conv.max(axis=0)
            places.append((conv == best).argmax(axis=0))
            pooled.append(best)
        return np.concatenate(pooled, 1) + self.bias, places

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 128, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on cross entropy; every language weighs the same."""
        rnd = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(LANGS)) / max(len(y), 1)
        weight = np.minimum(1 / np.maximum(share * len(LANGS), 1e-6), 6).astype(np.float32)
        params = [*self.filters, self.bias, self.dense, self.shift]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs):
            order = rnd.permutation(len(y))
            for s in range(0, len(y), batch):
                rows = order[s : s + batch]
                xb, yb = x[rows], y[rows]
                z, places = self._pool(xb)
                h = np.maximum(z, 0)
                p = softmax(h @ self.dense + self.shift)
                g = p.copy()
                g[np.arange(len(yb)), yb] -= 1
                g *= weight[yb][:, None] / len(yb)
                gz = (g @ self.dense.T) * (z > 0)
                grads = []
                for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                    gf = np.zeros_like(f)
                    part = gz[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        seen = np.take_along_axis(xb, places[i] + k, 1)
                        np.add.at(gf[k], (seen, np.arange(FILTERS)[None, :]), part)
                    grads.append(gf)
                grads += [gz.sum(0), h.T @ g + 1e-4 * self.dense, g.sum(0)]
                t += 1
                for q, d, a, b in zip(params, grads, m, v):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def packed(self) -> PackedNet:
        return PackedNet(self)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class PackedNet:
    """The same network for use: 8-bit tables over pairs of bytes.

    A table's row is 16 bytes, one number for each filter, so a look-up copies
    one machine word pair and sums and maxima run over whole columns.
    """

    def __init__(self, net: ByteNet):
        self.tables, self.scales = [], []
        for w, f in zip(WIDTHS, net.filters):
            pairs = [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w, 2)]
            scale = 127 / max(sum(float(np.abs(p[self._used()]).max()) for p in pairs), 1e-9)
            self.tables.append([np.ascontiguousarray(np.clip(np.rint(p * scale), -127 // len(pairs), 127 // len(pairs)).astype(np.int8)).view(np.complex128).ravel() for p in pairs])
            self.scales.append(scale)
        self.bias, self.dense, self.shift = net.bias, net.dense, net.shift

    @staticmethod
    def _used() -> np.ndarray:
        c = np.unique(_CLASSES).astype(np.int64)
        return (c[:, None] * 256 + c[None, :]).ravel()

    def log_probs(self, x: np.ndarray, chunk: int = 2048) -> np.ndarray:
        out = [self._chunk(x[s : s + chunk]) for s in range(0, len(x), chunk)]
        return np.concatenate(out) if out else np.zeros((0, len(LANGS)), np.float32)

    def _chunk(self, x: np.ndarray) -> np.ndarray:
        cols = np.ascontiguousarray(x.T).astype(np.int64)
        pairs = cols[:-1] * 256 + cols[1:]
        pooled = []
        for w, tables, scale in zip(WIDTHS, self.tables, self.scales):
            best = None
            for j in range(WINDOW - w + 1):
                total = tables[0].take(pairs[j]).view(np.int8)
                for k in range(1, len(tables)):
                    total = total + tables[k].take(pairs[j + 2 * k]).view(np.int8)
                best = total if best is None else np.maximum(best, total, out=best)
            pooled.append(best.reshape(-1, FILTERS).astype(np.float32) / scale)
        z = np.maximum(np.concatenate(pooled, 1) + self.bias, 0) @ self.dense + self.shift
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(texts: list[str], labels: list[str], seed: int = 7) -> ByteNet:
    """Rounds of fitting; each leaves out windows whose label the one before does not believe."""
    rnd = np.random.default_rng(seed)
    xs, ys = [], []
    for text, label in zip(texts, labels):
        x, _ = windows(lines_of(text))
        if len(x) > WINDOWS_A_DOC:
            x = x[np.sort(rnd.choice(len(x), WINDOWS_A_DOC, replace=False))]
        xs.append(x)
        ys.append(np.full(len(x), LANGS.index(label)))
    if not xs:
        return ByteNet(seed)
    x, y = np.concatenate(xs), np.concatenate(ys)
    epochs = int(np.clip(80_000 // max(len(y), 1), 3, 30))
    net, keep = ByteNet(seed), np.ones(len(y), bool)
    net.fit(x, y, max(epochs // 2, 2))
    for _ in range(ROUNDS):
        p = np.exp(net.packed().log_probs(x))
        keep = p[np.arange(len(y)), y] > DOUBT
        net = ByteNet(seed)
        net.fit(x[keep], y[keep], epochs)
    return net


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> ByteNet:
    """The network of a bounded sample of the labelled rows.

    The rows are those whose key hashes below a bound that a count of all
    labelled rows sets, so no task sorts or gathers more than the sample.
    """
    lang = label_language(F.col(label))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h"), F.col(text).alias("t"), lang.alias("l")).filter("l IS NOT NULL AND length(trim(t)) > 0")
    bound = int(min(1.0, 1.2 * sample / max(rows.count(), 1)) * (1 << 30))
    got = rows.filter(F.col("h") < bound).toArrow().sort_by([("h", "ascending"), ("t", "ascending"), ("l", "ascending")]).slice(0, sample)
    return train(got.column("t").to_pylist(), got.column("l").to_pylist())


def decode(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Likeliest languages of consecutive lines when each change costs ``switch``."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        move = best[top] - switch > best
        back[i] = np.where(move, top, np.arange(k))
        best = np.where(move, best[top] - switch, best) + scores[i]
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def judge(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """(language of each line, confidence of each line, whether the text is mixed)."""
    total = scores.sum(0)
    main = int(total.argmax())
    path = np.full(len(scores), main)
    if (scores.argmax(1) != main).any():
        path = decode(scores)
        while True:  # a language without clear evidence of its own joins the rest
            found = np.unique(path)
            if len(found) < 2:
                break
            gain = [scores[path == k, k].sum() - max(scores[path == k, j].sum() for j in found if j != k) for k in found]
            weakest = int(np.argmin(gain))
            if gain[weakest] >= EVIDENCE:
                break
            rest = [k for k in found if k != found[weakest]]
            masked = np.full_like(scores, -1e9)
            masked[:, rest] = scores[:, rest]
            path = decode(masked)
    mixed = len(np.unique(path)) > 1
    basis = scores if mixed else np.broadcast_to(total, scores.shape)
    conf = softmax(basis)[np.arange(len(path)), path]
    return path, conf, mixed


def table_starts(lines: list[str]) -> list[int]:
    """Where units of lines begin: the rows of one table and the heading right above are one unit, any other line is one."""
    first = [x.lstrip()[:1] for x in lines]
    return [i for i, c in enumerate(first) if not (i and c == "|" and first[i - 1] in ("|", "#"))]


_packed: dict[str, PackedNet] = {}


def label_documents(df: DataFrame, net: ByteNet, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seg_no, lang, confidence): seg_no -1 for a text in one language, else one row a line.

    One narrow stage; the network (some 200 KB whatever the corpus) is broadcast.
    """
    shared, name = df.sparkSession.sparkContext.broadcast(net), f"{id(net)}-{np.abs(net.dense).sum():.6f}"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _packed:
            _packed.clear()
            _packed[name] = shared.value.packed()
        fast = _packed[name]
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                batch = whole.slice(s, 500)
                docs = [lines_of(t) if t else [] for t in batch.column(1).to_pylist()]
                x, n = windows([line for doc in docs for line in doc])
                logs = fast.log_probs(x).astype(np.float64)
                per_line = np.add.reduceat(logs, np.cumsum(n) - n, axis=0) if len(n) else logs
                rows, segs, langs, confs = [], [], [], []
                at = 0
                for i, doc in enumerate(docs):
                    if not doc:
                        continue
                    first = table_starts(doc)
                    path, conf, mixed = judge(np.add.reduceat(per_line[at : at + len(doc)], first, axis=0))
                    times = np.diff([*first, len(doc)])
                    path, conf = np.repeat(path, times), np.repeat(conf, times)
                    at += len(doc)
                    m = len(doc) if mixed else 1
                    rows += [i] * m
                    segs += range(m) if mixed else (-1,)
                    langs += [LANGS[k] for k in path[:m]]
                    confs += conf[:m].tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(segs, pa.int32()), pa.array(langs, pa.string()), pa.array(confs, pa.float64())],
                    names=[key, "seg_no", "lang", "confidence"],
                )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, seg_no int, lang string, confidence double")


def wrong_labels(df: DataFrame, net: ByteNet, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``label_documents`` where the given label is missing or wrong, and every line of mixed texts.

    The label travels through the Python stage inside the key, so the result
    needs no join back.
    """
    both = df.select(F.struct(F.col(key).alias("k"), label_language(F.col(label)).alias("l")).alias("_key"), F.col(text).alias("_text"))
    out = label_documents(both, net, "_key", "_text")
    right = F.col("_key.l").eqNullSafe(F.col("lang"))
    return out.filter((F.col("seg_no") >= 0) | ~right).select(F.col("_key.k").alias(key), "seg_no", "lang", "confidence")
