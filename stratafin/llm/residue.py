"""Template residue and messages of failing services among texts that should be advice.

A regularised linear classifier on hashed features judges every segment
(sentence, line or JSON value) of a record; a record is refused if one of its
segments is.  Nothing else refuses: the phrases below only make labels.  A
segment is judged by its form, in which numbers are equal but for the codes 4xx
and 5xx, so its score depends on nothing read before.  Features are word
n-grams, n-grams of the characters' shapes (``{{a}}``, ``[A A]``), length and
title features.  The labels are weak: a form with a status or residue phrase is
bad, one made wholly of word pairs that are common over the corpus is good,
others teach nothing.  The fit takes records of a part of the groups (``host``);
it is validated on the rest, and on phrases whose whole family it was not told.

Defined results: null has no case, empty and blank texts are no case; JSON is
read as its text; very long texts are judged segment by segment; repeated rows
are judged each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets; records the fit takes at most; share of the hosts it does not see.
BUCKETS, SAMPLE, UNSEEN = 1 << 16, 20_000, 0.2
#: A pair of words is common from this share of the records on.
COMMON = 0.002
#: Weight decay, steps of the fit and their length, score from which a segment is refused.
DECAY, STEPS, RATE, REFUSE = 1e-6, 200, 0.05, 0.5
#: Parts of the phrases that are held out in turn for validation.
FOLDS = 4

#: Phrases that services, scripts and unfinished templates leave (weak labels).
STATUS = [
    r"\b(?:http|error|ошибка|status|code|код|статус|сбой)\b[^\w\n]{0,6}(?:\d\.\d )?[45]\d\d\b", r"\b[45]\d\d\b[^\w\n]{0,4}(?:bad|internal|service|not found|forbidden|gateway|request|payload|unauthori[sz]ed|too many|страница)",
    r"traceback \(most recent", r'file "[^"\n]+", line \d', r"\b(?:timeout|connection|runtime|value|key|type|memory)error\b", r"internal server error", r"bad gateway", r"service (?:temporarily )?unavailable", r"gateway timeout", r"request timeout", r"payload too large",
    r"too many requests", r"retry after \d", r"upstream connect error", r"reset before headers", r"access (?:is )?denied\.", r"permission to (?:view|access)", r"requested url was not found", r"страница не найдена", r"вернитесь на главную", r"внутренняя ошибка сервера",
    r"сервис\w* \w+ не отвечает", r"сервер вернул", r"не удалось получить ответ", r"ошибка (?:соединения|запроса)", r"истекло время ожидания", r"сессии? ист[её]к", r"сессия ист", r"session (?:has )?expired", r"(?:sign|log) in again", r"войдите снова", r"повторите (?:запрос|попытку)", r"попробуйте позже", r"try again later",
    r"обратитесь к администратору", r"доступ (?:запрещ|закры|огранич)", r"недостаточно прав", r'^\s*\{\s*"(?:error|status|detail)"', r"model runner has stopped", r"enable (?:java)?script", r"включите javascript", r"scripts? and cookies", r"выполнение скриптов", r"<noscript", r"javascript is disabled", r"файлы cookie", r"не поддерживает сценарии",
    r"вы не робот", r"not a robot", r"you are (?:a )?human", r"captcha", r"проверка безопасности", r"checking your browser",
]
RESIDUE = [
    r"\{\{.*?\}\}", r"\$\{[^}\n]*\}", r"\{%.*?%\}", r"\{[A-Za-zА-Яа-яё_0-9]?[\w .]*\}", r"<%.*?%>", r"(?<![\w%])%[A-Z_]{3,}%", r"<[A-Za-zА-Яа-яё_][A-Za-zА-Яа-яё_ ]*>", r"\[\[[^\]\n]+\]\]", r"\[[A-Za-zА-Яа-яё_][^\]\n\d\"{]*\](?!\()", r"%\([^)\n]+\)[sd]", r"%%\w+%%", r"@@\w+@@", r"\$[A-Za-z_]+\$", r"__+\w+?__+", r"(?<!\w)_{3,}(?!\w)", r"(?<![#\w])#[A-Za-zА-Яа-яё_]+#", r"\bX{2,}[,.]X+", r"\bX{3,}\b", r"<!--.*?-->",
    r"#(?:VALUE|REF|NAME|NULL|DIV/0)[!?]", r"#N/A", r"\bTBD\b", r"\bTODO\b", r"\bundefined\b", r"\bnull\b", r"\bNaN\b",
]
FILLER = [
    r"\b(?:lorem|ipsum|adipiscing|consectetur|eiusmod|incididunt|aliqua|nostrud|tempor|amet|veniam|labore|dolore|eiusmod|ullamco)\b", r"\bтест тест", r"\btest test", r"\basdf\b", r"\bqwerty\b", r"рыба[- ]текст", r"текст[- ](?:заглушка|заполнитель|рыба)", r"пример рекомендации", r"^\W*(?:абзац|параграф|строка|paragraph|line) (?:номер|number|no\.?|№) \w+\W*$", r"здесь (?:будет|должен быть)", r"text goes here", r"sample text", r"placeholder text", r"заполнить позже",
]
PHRASES = [(re.compile(p, re.I | re.S), False) for p in STATUS + FILLER] + [(re.compile(p), True) for p in RESIDUE]
_HTML = re.compile(r"</?(?:p|b|i|hr|br|h[1-6]|html|head|title|body|center|div|span|ul|li|strong|em|noscript)\b[^>]*>", re.I)
_SPLIT = re.compile(r"\n+|(?<=[.!?])\s+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_SHAPE = ((re.compile(r"[a-zа-яё]+"), "a"), (re.compile(r"[A-ZА-ЯЁ]+"), "A"), (re.compile(r"\d+"), "0"))


def json_texts(text: str) -> list[str] | None:
    """The strings of a JSON list of strings or objects; None if the text is no such list."""
    import json

    if text.lstrip()[:1] != "[":
        return None
    try:
        got = json.loads(text)
    except ValueError:
        return None
    out: list[str] = []
    stack = [got]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            stack += reversed(list(x.values()))
    return out


def segments(text: str) -> list[str]:
    parts = json_texts(text)
    return [s for p in (parts if parts is not None else [text]) for s in _SPLIT.split(p) if s.strip()]


def words(segment: str) -> list[str]:
    """Lower-case words; numbers as 0, capitalised words inside a sentence as one name."""
    out = []
    for i, m in enumerate(_WORD.finditer(segment)):
        w = m.group()
        out.append("0" if w.isdigit() else "Name" if i and w[:1].isupper() and w[1:].islower() else w.lower())
    return out


def word_pairs(segment: str) -> list[tuple[str, str]]:
    w = words(segment)
    return list(zip(["^", *w], [*w, "$"]))


def form(segment: str) -> str:
    """A segment with its numbers made equal, codes of failing services apart."""
    return _FORM.sub(lambda m: "500" if len(m.group()) == 3 and m.group()[0] in "45" else "0", segment)


_FORM = re.compile(r"(?<!\d)[45]\d\d(?!\d)|\d+")


def phrases_in(segment: str) -> list[int]:
    """The places in ``PHRASES`` of what a segment holds."""
    bare = _HTML.sub(" ", segment)
    return [i for i, (p, tagged) in enumerate(PHRASES) if p.search(bare if tagged else segment)]


def shape(segment: str) -> str:
    for pattern, to in _SHAPE:
        segment = pattern.sub(to, segment)
    return " ".join(segment.split())


def features(segment: str) -> np.ndarray:
    """Hash buckets of a form's features, each once, ascending."""
    w = words(segment)
    named = {f"w{x}" for x in w} | {f"b{x} {y}" for x, y in zip(w, w[1:])}
    named.add(f"n{min(len(w), 40) // 4}")
    named.add(f"t{segment.strip().endswith(':')}{segment.isupper()}{segment.lstrip()[:2]}")
    named.add(f"u{sum(c.isupper() for c in segment) * 8 // max(len(segment), 1)}")
    parts = [np.array([zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in named], np.int64)]
    chars = np.frombuffer(shape(segment).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    grams = chars
    for n in (2, 3, 4, 5):
        if len(chars) < n:
            break
        grams = grams[:-1] * _MIX + chars[n - 1 :]
        parts.append(((((grams ^ (grams >> np.uint64(29))) * _MIX + np.uint64(n)) >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.unique(np.concatenate(parts))


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Judge:
    """Weights over hash buckets; a segment's score is the mean of its features' weights, scaled by their root."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.memo = weights, bias, {}

    def score(self, segment: str) -> float:
        key = form(segment)
        got = self.memo.get(key)
        if got is None:
            f = features(key)
            got = float(1 / (1 + np.exp(-(self.weights[f].sum() / np.sqrt(len(f)) + self.bias))))
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[key] = got
        return got

    def text(self, text: str) -> float:
        return max(map(self.score, segments(text)), default=0.0)


def learn(rows: list[np.ndarray], labels: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with weight decay by ``STEPS`` steps of Adam over all forms.

    A form weighs as the root of the times it occurs; both classes weigh the same.
    """
    if not rows:
        return np.zeros(BUCKETS), -10.0
    size = np.array([len(r) for r in rows])
    at, of, k = np.concatenate(rows), np.repeat(np.arange(len(rows)), size), 1 / np.sqrt(size)
    weight = np.sqrt(times)
    for kind in (True, False):
        weight[labels == kind] *= 0.5 / max(weight[labels == kind].sum(), 1e-6)
    w, mean, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the bias is the last
    for t in range(1, STEPS + 1):
        z = np.bincount(of, w[at], len(rows)) * k + w[-1]
        d = (1 / (1 + np.exp(-z)) - labels) * weight
        grad = np.append(np.bincount(at, (d * k)[of], BUCKETS) + DECAY * w[:-1], d.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        w -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def weak_rows(texts: list[str], without: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(forms with a weak label, each once; labels; how often each occurs).

    ``without`` names a fold of the phrases that is held out: forms with such a
    phrase are left out altogether.
    """
    split = [[form(s) for s in segments(t)] for t in texts]
    pairs = Counter(p for parts in split for p in {q for s in parts for q in word_pairs(s)})
    floor = max(3, COMMON * len(texts))
    kept, labels, times = [], [], []
    for s, n in sorted(Counter(s for parts in split for s in parts).items()):
        said = phrases_in(s)
        if any(i % FOLDS == without for i in said):
            continue
        if said or all(pairs[q] >= floor for q in word_pairs(s)):
            kept.append(s)
            labels.append(bool(said))
            times.append(n)
    return kept, np.array(labels, bool), np.array(times, float)


def sampled(df: DataFrame, text: str, host: str, key: str, sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` texts of seen hosts, in the order of a hash of the record's key (so copies are drawn one by one)."""
    rows = df.filter(seen_host(F.col(host)) & F.col(text).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("t"))
    cut = int(min(1.0, 1.2 * sample / max(rows.count(), 1)) * (1 << 30))
    got = rows.filter(F.pmod("h", F.lit(1 << 30)) < cut).toArrow().sort_by([("h", "ascending"), ("t", "ascending")])
    return got.slice(0, sample).column("t").to_pylist()


def fit(texts: list[str], without: int | None = None) -> Judge:
    kept, labels, times = weak_rows(texts, without)
    return Judge(*learn([features(s) for s in kept], labels, times))


def fit_judge(df: DataFrame, text: str, host: str, key: str, sample: int = SAMPLE) -> Judge:
    """The classifier of a bounded sample of records whose host is seen."""
    return fit(sampled(df, text, host, key, sample))


def seen_host(host):
    """Whether the fit may see a host; null hosts are seen."""
    return F.coalesce(F.pmod(F.xxhash64(host.cast("string")), F.lit(100)) >= int(UNSEEN * 100), F.lit(True))


def judge_texts(df: DataFrame, judge: Judge, text: str, out: str = "residue") -> DataFrame:
    """``df`` without ``text``, with the score of its worst segment (0 for null)."""
    shared = df.sparkSession.sparkContext.broadcast((judge.weights.astype(np.float32), judge.bias))
    keep = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(*shared.value)
        for batch in batches:
            scores = [own.text(t) if t else 0.0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*keep, out])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(text, *keep).mapInArrow(run, f"{kinds}`{out}` double")


def validate(df: DataFrame, text: str, host: str, key: str, sample: int = SAMPLE) -> DataFrame:
    """(family, refused, n): records of unseen hosts by whether the classifier refuses them.

    ``family`` is ``told`` for records with a phrase of which the fit knew,
    ``held out`` for records all of whose phrases are of the part of ``PHRASES``
    the judging classifier was not told of (each part in turn), ``none`` for
    records without any phrase (judged by every one of these classifiers).
    """
    texts = sampled(df, text, host, key, sample)
    judges = [fit(texts, k) for k in range(FOLDS)]
    shared = df.sparkSession.sparkContext.broadcast([(j.weights.astype(np.float32), j.bias) for j in judges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = [Judge(*x) for x in shared.value], Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                parts = {i % FOLDS for s in segments(t) for i in phrases_in(form(s))}
                for k, judge in enumerate(own):
                    family = "none" if not parts else "held out" if parts == {k} else "told" if k not in parts else None
                    if family:
                        seen[family, judge.text(t) >= REFUSE] += 1
        cells = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.string()), pa.array([c[1] for c in cells], pa.bool_()), pa.array([seen[c] for c in cells], pa.int64())], names=["family", "refused", "n"])

    rows = df.filter(~seen_host(F.col(host)) & F.col(text).isNotNull()).select(text)
    return rows.mapInArrow(run, "family string, refused boolean, n bigint").groupBy("family", "refused").agg(F.sum("n").alias("n"))
