"""From a report's lines to its analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.operators import ratios, statements
from stratafin.operators.statements import FIELDS
from stratafin.session import stage

#: Fixed value: what the result names as the reader of its lines.
PROCESSOR = "parse_financial_pdf"


def strategies(documents: DataFrame, structured: DataFrame, plain: DataFrame, direct: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """One row a document of ``documents`` (key, others kept): the strategy, its facts, scores and numbers of lines.

    ``structured`` and ``plain`` hold the lines (key, line_no, line) of either
    reading; a document without structured lines takes its plain ones for both,
    a document without any has no facts and still a row. ``direct`` holds lines
    read from the file itself; where there are none its score is -1, which never
    wins, and when it wins its lines are not counted. The earlier strategy wins
    ties. Facts are one narrow row a document; texts are not joined.
    """
    facts = lambda lines, name: statements.extract_facts(lines, key, count="rows").select(key, F.struct("rows", *FIELDS).alias(name))
    out = documents.join(facts(structured, "_s"), key, "left").join(facts(plain, "_p"), key, "left")
    out = out.join(facts(direct, "_d"), key, "left") if direct is not None else out.withColumn("_d", F.lit(None).cast(out.schema["_p"].dataType))
    out = out.withColumn("_s", F.coalesce("_s", "_p"))
    score = lambda c, none: F.coalesce(F.when(F.col(c).isNotNull(), _known(c)), F.lit(none)).cast("int")
    rows = lambda c: F.coalesce(F.col(f"{c}.rows"), F.lit(0)).cast("bigint")
    out = out.select("*", score("_s", 0).alias("score_structured"), score("_p", 0).alias("score_plain"), score("_d", -1).alias("score_direct"), rows("_s").alias("rows_structured"), rows("_p").alias("rows_plain"))
    first = F.when(F.col("score_plain") > F.col("score_structured"), "plain").otherwise("structured")
    chosen = F.when(F.col("score_direct") > F.greatest("score_structured", "score_plain"), "direct").otherwise(first)
    out = out.withColumn("strategy", chosen)
    best = F.when(F.col("strategy") == "direct", F.col("_d")).when(F.col("strategy") == "plain", F.col("_p")).otherwise(F.col("_s"))
    lines = F.when(F.col("strategy") == "direct", 0).when(F.col("strategy") == "plain", F.col("rows_plain")).otherwise(F.col("rows_structured"))
    out = out.withColumn("_b", best).withColumn("line_count", lines.cast("bigint"))
    return out.select(*documents.columns, "strategy", F.lit(PROCESSOR).alias("processor"), "line_count", *DETAILS, *[F.col(f"_b.{f}").alias(f) for f in FIELDS])


DETAILS = ("score_structured", "score_plain", "score_direct", "rows_structured", "rows_plain")


def _known(c: str) -> Column:
    return sum((F.col(f"{c}.{f}").isNotNull().cast("int") for f in FIELDS), F.lit(0))


def analyze(chosen: DataFrame, files: DataFrame, date: str, key: str = "doc_id") -> DataFrame:
    """One row a document: file_name, date, coefficients, warnings, metrics, facts, parse_meta.

    ``chosen`` is the result of ``strategies``; ``files`` key and file_name. The
    date is given, so a result can be made again.
    """
    chosen = stage(chosen)  # twelve numbers a document, read twice
    shown = ratios.displayed(ratios.metrics(chosen, key))
    fields = ("ord", "metric", "title", "formula", "value", "display", "unit", "status", "hint")
    listed = shown.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("metrics"))
    known = F.filter("metrics", lambda m: m["value"].isNotNull())
    coefficient = lambda m: F.round(F.when(m["unit"] == "%", m["value"] * 100).otherwise(m["value"]), 4)
    details = F.struct(*DETAILS, F.col("strategy").alias("candidate"))
    meta = F.struct("strategy", "processor", "line_count", details.alias("details"))
    return chosen.join(listed, key).join(files.select(key, "file_name"), key, "left").select(
        key, "file_name", F.lit(date).alias("date"),
        F.map_from_entries(F.transform(known, lambda m: F.struct(m["title"], coefficient(m)))).alias("coefficients"),
        ratios.warning_texts().alias("warnings"), "metrics", F.struct(*FIELDS).alias("facts"), meta.alias("parse_meta"),
    )
