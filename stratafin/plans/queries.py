"""Registered queries of the core operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafin.functions import jsons
from stratafin.functions import text as T
from stratafin.operators import arbitration, layout, model_calls, nested, pages, ratios, report, statements, units
from stratafin.plans import pipeline
from stratafin.plans.oracles import ORACLES  # noqa: F401
from stratafin.sources.tables import newest, once, table

REPORT_DATE = "2026-01-01"


# --- inputs -----------------------------------------------------------------


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(table(spark, sf_dir, "financial_facts"), "fact_id", "ingested_at")


def _blocks(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "blocks"), "block_id", "ingested_at", *cols, "ingested_at").drop("ingested_at")


def _parses(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "parser_result"), "result_id", "ingested_at", *cols, "ingested_at").drop("ingested_at")


def _parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of every parse's plain text; the parse is the document."""
    texts = _parses(spark, sf_dir, "plain_text").select(F.col("result_id").alias("doc_id"), F.lit(0).alias("_p"), F.col("plain_text").alias("text"))
    return statements.numbered_lines(texts, "doc_id", "text", ["_p"])


def _block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir, "doc_id", "page_number", "block_no", "content").filter("doc_id IS NOT NULL")
    return statements.structured_lines(blocks, "doc_id", order=("page_number", "block_no", "block_id"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitration.pick_strategy(_facts(spark, sf_dir).drop("ingested_at"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.metrics(_best(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page candidates by method, with a confidence that depends on method and page."""
    blocks = _blocks(spark, sf_dir, "doc_id", "page_number", "block_no", "method", "content").filter("doc_id IS NOT NULL")
    method = pages.method_of(F.coalesce("method", F.lit("none")))
    listed = F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("block_no", "block_id", "content"))))
    got = blocks.groupBy("doc_id", "page_number", method.alias("method")).agg(F.array_join(F.transform(listed, lambda b: b["content"]), "\n").alias("text"))
    seen = 0.6 + 0.0371 * F.pmod(F.col("page_number"), F.lit(5))
    return got.withColumn("confidence", F.coalesce(pages.layer_confidence(F.col("method"), F.col("text")), seen))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir, "doc_id", "page_number", "block_no", "content", "y").filter("doc_id IS NOT NULL")
    return blocks.select("doc_id", "page_number", F.col("block_id").alias("pos"), "y", F.pmod(F.col("block_no") * 37, F.lit(200)).cast("double").alias("x"), F.coalesce("content", F.lit("")).alias("text"))


def _number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_id, line_no, line): lines of blocks with only what tables of numbers are made of."""
    rows = _blocks(spark, sf_dir, "content").select("block_id", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("line", F.regexp_replace("line", r"[^0-9 .,()|=\-]", ""))


# --- queries ----------------------------------------------------------------


def strategy_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("doc_id", "strategy", "score", "fact_id")


def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("doc_id", "metric", "value", "status")


def metric_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.displayed(_metrics(spark, sf_dir)).select("doc_id", "metric", "display")


def report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.warnings(_best(spark, sf_dir))


def report_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.coefficients(_metrics(spark, sf_dir)).select("doc_id", "title", "coefficient")


def facts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.facts_summary(_best(spark, sf_dir))


def metrics_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.metrics_prompt(ratios.displayed(_metrics(spark, sf_dir)))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = newest(table(spark, sf_dir, "filings"), "doc_id", "ingested_at", "file_name", "ingested_at")
    reports = _best(spark, sf_dir).join(names, "doc_id", "left").withColumns({"file_name": F.coalesce("file_name", F.lit("—")), "date": F.lit(REPORT_DATE)})
    return report.report_rows(reports).select("doc_id", "section", "ord", F.array_join("cells", " | ").alias("text"))


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_balance_first(ratios.displayed(_metrics(spark, sf_dir))).select("doc_id", "ord", "title", "display")


def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parse_lines(spark, sf_dir)


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.numbers(F.col("line"))
    total = F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 3)
    return _parse_lines(spark, sf_dir).select("doc_id", "line_no", F.size(n).alias("n"), total.alias("total"))


def line_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parse_lines(spark, sf_dir).select("doc_id", "line_no", F.explode(T.years(F.col("line"))).alias("year"))


def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parse_lines(spark, sf_dir).select("doc_id", "line_no", F.array_join(T.columns(F.col("line")), "¦").alias("cells"))


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.keyword_lines(_parse_lines(spark, sf_dir)).groupBy("doc_id", "field").agg(F.count("*").alias("n_lines"))


def year_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    header = T.is_year_header(line, T.years(line), T.numbers(line))
    return _parse_lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(header).alias("n_headers"), F.count_if(T.is_page_break(line)).alias("n_breaks"))


def year_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements.with_year_context(_parse_lines(spark, sf_dir))
    return rows.filter(~F.col("is_header")).select("doc_id", "line_no", F.array_join(F.col("context").cast("array<string>"), ",").alias("context"))


def plain_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.extract_facts(_parse_lines(spark, sf_dir))


def structured_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.extract_facts(_block_lines(spark, sf_dir))


def chosen_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report with the facts of its better reading.

    A report held in ``parser_result`` is read from the nested blocks of its
    latest successful parse (its plain text where there are none); one that
    arrived as flat rows from those. Both readings are made by parse, and the
    parse is chosen among narrow rows.
    """
    parses = _parses(spark, sf_dir, "plain_text", "pages")
    whole = parses.select(F.concat(F.lit("parse "), "result_id").alias("doc_id"), "plain_text", "pages")
    nested_lines = statements.record_lines(nested.unnest(whole, "doc_id", "pages", None), "doc_id")
    plain = statements.numbered_lines(whole.withColumn("_p", F.lit(0)), "doc_id", "plain_text", ["_p"])
    flat = _block_lines(spark, sf_dir)
    latest = F.max_by("result_id", F.struct(F.coalesce("success", F.lit(False)), "ingested_at", "result_id"))
    of_parse = table(spark, sf_dir, "parser_result").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(latest.alias("_id")).select(F.col("doc_id").alias("report"), F.concat(F.lit("parse "), "_id").alias("doc_id"))
    of_rows = table(spark, sf_dir, "blocks").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("report"), "doc_id").distinct()
    documents = of_parse.union(of_rows.join(of_parse.select("report"), "report", "left_anti").select("report", "doc_id"))
    return pipeline.strategies(documents, nested_lines.union(flat), plain).drop("doc_id").withColumnRenamed("report", "doc_id")


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of every report, its nested parts as plain columns."""
    files = newest(table(spark, sf_dir, "filings"), "doc_id", "ingested_at", "file_name", "ingested_at")
    out = pipeline.analyze(chosen_strategies(spark, sf_dir), files, REPORT_DATE)
    statuses = F.array_join(F.transform("metrics", lambda m: m["status"]), ",")
    return out.select("doc_id", "file_name", "date", F.size("coefficients").alias("n_coefficients"), F.array_join("warnings", "\n").alias("warnings"), statuses.alias("statuses"), "parse_meta.strategy", "parse_meta.processor", "parse_meta.line_count", *[f"parse_meta.details.{c}" for c in pipeline.DETAILS], "facts.*")


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every parse's nested blocks."""
    return statements.record_lines(nested.unnest(table(spark, sf_dir, "parser_result")))


def preview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.preview_lines(_parse_lines(spark, sf_dir))


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, "content").filter("content IS NOT NULL").select("block_id", T.block_kind(F.col("content")).alias("kind"))


def plain_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_markup(F.col("text")).alias("text"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_calls.chunked(table(spark, sf_dir, "documents").select("doc_id", "text"), size=500)


def resolved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.resolve_pages(_candidates(spark, sf_dir)).select("doc_id", "page_number", "method", "confidence", "extracted", F.length("text").alias("n_chars"))


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.page_summary(pages.resolve_pages(_candidates(spark, sf_dir)))
    return out.withColumn("methods", F.array_join("methods", ","))


def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.joined_pages(pages.resolve_pages(_candidates(spark, sf_dir)))


def page_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir, "doc_id", "page_number", "block_no", "content").filter("doc_id IS NOT NULL")
    return pages.rank_pages(pages.page_texts(blocks)).select("doc_id", "page_number", "score", "rank")


def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_regions(_number_lines(spark, sf_dir), ["block_id"]).filter("region IS NOT NULL").select("block_id", "line_no", "region")


def repaired_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir, "content").filter("content IS NOT NULL")
    return layout.repair_tables(blocks.select("block_id", F.col("content").alias("text")), ["block_id"])


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_items(spark, sf_dir), ["doc_id", "page_number"]).select("doc_id", "page_number", F.col("pos").alias("block_id"), "ord")


def grouped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.group_lines(layout.reading_order(_items(spark, sf_dir), ["doc_id", "page_number"]), ["doc_id", "page_number"])


def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("Sure: ```json\n"), "props", F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(jsons.object_in(reply), F.lit("k")).alias("k"))


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return arbitration.first_known(events, ["user_id", "event_type"], "value", "at")


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return arbitration.last_known(events, ["user_id", "event_type"], "value", "at")


def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitration.distinct_in_order(table(spark, sf_dir, "documents"), "source", "doc_id")


def display_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("fact_id", T.display_number(F.col("revenue")).alias("shown"))


def mixed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of every line as a number, whichever mark it has for decimals."""
    return _parse_lines(spark, sf_dir).select("doc_id", "line_no", T.mixed_number(F.regexp_extract("line", r"(\S+)$", 1)).alias("value"))


def recommendation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = once(table(spark, sf_dir, "recommendations"), "rec_id", "created_at", "recommendations", "created_at")
    return recs.select("rec_id", report.recommendation_text(F.col("recommendations")).alias("text"))


def extracted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return model_calls.extract_keys(docs, ["EBITDA", "выручка", "net profit"])


def merged_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations read as replies that may be lists: the members of their objects merged."""
    recs = once(table(spark, sf_dir, "recommendations"), "rec_id", "created_at", "recommendations")
    m = jsons.merged_value(F.col("recommendations"))
    return recs.withColumn("m", m).select("rec_id", F.size("m").alias("n"), F.try_element_at("m", F.lit("параметр")).alias("parameter"), F.try_element_at("m", F.lit("норма")).alias("norm"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_texts(_blocks(spark, sf_dir, "doc_id", "page_number", "block_no", "content").filter("doc_id IS NOT NULL AND content IS NOT NULL"))


def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir, "doc_id", "page_number", "block_no", "content").filter("doc_id IS NOT NULL")
    return model_calls.block_chunks(blocks, order=("page_number", "block_no", "block_id"))


def joined_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir, "doc_id", "page_number", "block_no", "content").filter("doc_id IS NOT NULL")
    return model_calls.joined_contents(blocks, order=("page_number", "block_no", "block_id"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read one by one: their items as lines by exact height."""
    return layout.single_page_text(_items(spark, sf_dir), ["doc_id", "page_number"])


def report_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the converted fields with its unit and in million roubles."""
    blocks, parses = table(spark, sf_dir, "blocks"), table(spark, sf_dir, "parser_result")
    none = F.lit(None).cast("int")
    texts = blocks.select("doc_id", F.col("page_number").alias("page"), F.col("block_no").alias("block"), F.col("content").alias("text"))
    texts = texts.union(parses.select("doc_id", none, none, "plain_text"))
    return units.common_units(table(spark, sf_dir, "financial_facts"), texts, table(spark, sf_dir, "fx_rates"), ("page", "block"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.in_other_units(report_units(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.node_table(nested.unnest(table(spark, sf_dir, "parser_result")))


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.page_table(nested.unnest(table(spark, sf_dir, "parser_result")))


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.block_table(nested.unnest(table(spark, sf_dir, "parser_result")))


_REFERENCE = (
    strategy_pick, report_metrics, metric_displays, report_warnings, report_coefficients, facts_summary, metrics_prompt, report_rows, preview_rows, parse_lines, line_numbers, line_years, line_columns, keyword_lines,
    year_headers, year_context, plain_facts, structured_facts, analysis, record_lines, preview_lines, block_kinds, plain_markup, text_chunks, resolved_pages, page_summary, joined_pages, page_ranking, table_regions, repaired_tables, reading_order,
    grouped_lines, json_replies, first_wins, last_wins, distinct_sources, display_numbers, mixed_numbers, recommendation_texts, extracted_keys, merged_replies, page_texts, block_chunks, joined_contents, page_lines,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _REFERENCE} | {
    "p3_found": p3_found,
    "p3_values": report_units,
    "p5_found": p5_found,
    "p5_pages": p5_pages,
    "p5_blocks": p5_blocks,
}
