"""Sources combined to target shares of the whole, by pivotal dependent rounding.

Every document of a source has the same expected number of copies: its source's
share of the whole over the source's size in tokens.  The whole part is taken;
the fractions are rounded in pairs: mass, measured in tokens, moves between two
documents in a random direction until one of them is integral, so a source's
tokens stay exactly what they were and every expectation is kept.  Documents
meet in buckets of bounded size; the one residual each bucket leaves goes up a
reduction tree, and the last one of a source is rounded by itself.  A source is
thus off its target by less than one document.

Randomness comes from hashes of the ids and ``seed``: a task that is run again
decides alike.

Defined results: documents without a source, of a source without a target, or
without tokens (null, empty) are not used; a source without documents is
reported with no tokens and its share goes to the others in proportion; if no
size is asked for, it is the largest at which every source can reach its share
within ``max_repeats``; if the size asked for is larger, a source is used to its
cap and reported short.  Ids are taken to be unique.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafin.session import stage

#: Documents of one bucket; residuals that meet in one node of the tree.
BUCKET, FANIN = 20_000, 256


def source_plan(sized: DataFrame, targets: DataFrame, total: float | None = None) -> list[dict]:
    """Per source of ``targets`` (a small fixed table): size, share, expected copies of a document."""
    used = sized.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    rows = [r.asDict() for r in targets.filter("source IS NOT NULL").join(used, "source", "left").collect()]
    there = sum(r["target_share"] for r in rows if r["n_tokens"])
    cap = min((r["n_tokens"] * r["max_repeats"] * there / r["target_share"] for r in rows if r["n_tokens"] and r["target_share"] > 0), default=0.0)
    whole = cap if total is None else float(total)
    for r in rows:
        r["n_tokens"], r["n_docs"] = r["n_tokens"] or 0, r["n_docs"] or 0
        want = whole * r["target_share"] / there if r["n_tokens"] else 0.0
        r["copies"] = min(want / r["n_tokens"], float(r["max_repeats"])) if r["n_tokens"] else 0.0
    return rows


def _chance(*parts) -> float:
    """A number in [0, 1) that depends on the parts alone."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(ids: list, sizes: list[float], probs: list[float], seed: int) -> tuple[list[int], int | None, float]:
    """(rounded values, place of the residual or None, its probability) after pairing in order."""
    out, held, p = [0] * len(ids), None, 0.0
    for i, q in enumerate(probs):
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[i] = int(q > 0.5)
            continue
        if held is None:
            held, p = i, q
            continue
        a, b = sizes[held], sizes[i]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        if _chance(seed, ids[held], ids[i]) * (up + down) < down:
            p, q = p + up / a, q - up / b
        else:
            p, q = p - down / a, q + down / b
        for k, x in ((held, p), (i, q)):
            if x <= 1e-9 or x >= 1 - 1e-9:
                out[k] = int(x > 0.5)
        open_p, open_q = 1e-9 < p < 1 - 1e-9, 1e-9 < q < 1 - 1e-9
        held, p = (held, p) if open_p else (i, q) if open_q else (None, 0.0)
    return out, held, p


_FIELDS = "doc_id bigint, source string, n_tokens bigint, base int, p double, extra int, node bigint"


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents used, from (doc_id, source, n_tokens)."""
    spark = sized.sparkSession
    sized = stage(sized.select("doc_id", "source", "n_tokens"))
    plan = [r for r in source_plan(sized, targets, total) if r["copies"] > 0]
    buckets = max((math.ceil(r["n_docs"] / BUCKET) for r in plan), default=1)
    rates = spark.createDataFrame([(r["source"], int(r["copies"] + 1e-12), max(0.0, r["copies"] - int(r["copies"] + 1e-12)), math.ceil(r["n_docs"] / BUCKET)) for r in plan], "source string, base int, p double, parts int")
    node = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("parts").cast("bigint"))
    level = sized.filter("n_tokens > 0").join(F.broadcast(rates), "source").select("doc_id", "source", "n_tokens", "base", "p", F.lit(None).cast("int").alias("extra"), node.alias("node"))

    def settle(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id").reset_index(drop=True)
            out, held, p = pivot(pdf.doc_id.tolist(), pdf.n_tokens.tolist(), pdf.p.tolist(), seed)
            extra = pd.Series(out, dtype="Int32")
            if held is not None:
                extra[held] = int(_chance(seed, "last", int(pdf.doc_id[held])) < p) if last else pd.NA
                pdf.loc[held, "p"] = p
            pdf["extra"] = extra
            return pdf[["doc_id", "source", "n_tokens", "base", "p", "extra", "node"]]

        return run

    done = []
    while True:
        last = buckets == 1
        level = stage(level.groupBy("source", "node").applyInPandas(settle(last), _FIELDS))
        done.append(level.filter("extra IS NOT NULL"))
        if last:
            break
        buckets = math.ceil(buckets / FANIN)
        level = level.filter("extra IS NULL").withColumn("node", F.floor(F.col("node") / FANIN).cast("bigint"))
    chosen = done[0]
    for d in done[1:]:
        chosen = chosen.union(d)
    return chosen.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("extra")).alias("copies")).filter("copies > 0")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Every source of ``targets`` with documents, copies and tokens used, and the share reached against its target."""
    used = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
    rows = targets.join(used, "source", "left").na.fill(0, ["n_docs", "n_copies", "most_repeats", "n_tokens"])
    whole = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # the targets are a small fixed table
    share = F.try_divide(F.col("n_tokens").cast("double"), whole)
    return rows.select("source", "target_share", "max_repeats", "n_docs", "n_copies", "most_repeats", "n_tokens", F.coalesce(share, F.lit(0.0)).alias("actual_share"))
