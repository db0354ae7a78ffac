"""Queries of the text operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafin.llm import bpe, canonical, language, lexicon, mixing, residue, scan
from stratafin.sources.tables import once as once_each
from stratafin.sources.tables import table


def report_texts(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """(rec_table, rec_id, text) of all blocks and parses; ``once`` leaves re-delivered rows out."""
    blocks, parses = table(spark, sf_dir, "blocks"), table(spark, sf_dir, "parser_result")
    if once:
        blocks = once_each(blocks, "block_id", "ingested_at", "content", "ingested_at")
        parses = once_each(parses, "result_id", "ingested_at", "plain_text", "ingested_at")
    a = blocks.select(F.lit("blocks").alias("rec_table"), F.col("block_id").alias("rec_id"), F.col("content").alias("text"))
    return a.union(parses.select(F.lit("parser_result"), "result_id", "plain_text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = report_texts(spark, sf_dir)
    words = lexicon.vocabulary(lexicon.count_words(texts, "text"))
    found = canonical.canonical_texts(texts.filter("text IS NOT NULL"), "text", words, only_changed=True)
    return found.select("rec_table", "rec_id").distinct()


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its text in the canonical form."""
    texts = report_texts(spark, sf_dir, once=True)
    words = lexicon.vocabulary(lexicon.count_words(report_texts(spark, sf_dir), "text"))
    return canonical.canonical_texts(texts, "text", words).select("rec_table", "rec_id", "canonical")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = table(spark, sf_dir, "recommendations").select("rec_id", "doc_id", "recommendations")
    judge = residue.fit_judge(recs, "recommendations", "doc_id", "rec_id")
    scored = residue.judge_texts(recs.select("rec_id", "recommendations"), judge, "recommendations")
    return scored.filter(F.col("residue") >= residue.REFUSE).select("rec_id").distinct()


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once with its score and whether it is kept as advice (null is not)."""
    recs = once_each(table(spark, sf_dir, "recommendations"), "rec_id", "created_at", "doc_id", "model", "recommendations", "created_at")
    judge = residue.fit_judge(recs, "recommendations", "doc_id", "rec_id")
    scored = residue.judge_texts(recs.select("rec_id", "recommendations", F.col("recommendations").isNotNull().alias("given")), judge, "recommendations")
    return scored.select("rec_id", "residue", (F.col("given") & (F.col("residue") < residue.REFUSE)).alias("kept"))


def p2_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier on reports its fit did not see, by whether it was told of the phrases' family."""
    recs = table(spark, sf_dir, "recommendations").select("rec_id", "doc_id", "recommendations")
    return residue.validate(recs, "recommendations", "doc_id", "rec_id")


def placed_texts(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """(rec_table, rec_id, doc, page, block_no, text): blocks by report and page, parses as one report each."""
    blocks, parses = table(spark, sf_dir, "blocks"), table(spark, sf_dir, "parser_result")
    if once:
        blocks = once_each(blocks, "block_id", "ingested_at", "doc_id", "page_number", "block_no", "content", "ingested_at")
        parses = once_each(parses, "result_id", "ingested_at", "plain_text", "ingested_at")
    none = F.lit(None).cast("int")
    a = blocks.select(F.lit("blocks").alias("rec_table"), F.col("block_id").alias("rec_id"), F.col("doc_id").alias("doc"), F.col("page_number").alias("page"), "block_no", F.col("content").alias("text"))
    return a.union(parses.select(F.lit("parser_result"), "result_id", F.concat(F.lit("parse "), "result_id"), none, none, "plain_text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = placed_texts(spark, sf_dir)
    return scan.find_noise(texts, scan.Lexicon.of(lexicon.count_words(texts, "text")))


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as continuous paragraphs, free of what scanning added."""
    texts = placed_texts(spark, sf_dir, once=True)
    return scan.repair_texts(texts, scan.Lexicon.of(lexicon.count_words(placed_texts(spark, sf_dir), "text")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether their ids decode to the very text (null counts as empty)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.decode_documents(bpe.encode_documents(docs)).withColumnRenamed("text", "decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return docs.join(back, "doc_id").groupBy(same.alias("same")).agg(F.count("*").alias("n_docs"))


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, by the public tokenizer."""
    return bpe.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.reached_shares(mixing.mix(sized_documents(spark, sf_dir), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.wrong_labels(docs, language.fit_languages(docs)).select("doc_id", "seg_no", "lang")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and every line of the mixed ones, with language and confidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.label_documents(docs, language.fit_languages(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p2_found": p2_found,
    "p2_kept": p2_kept,
    "p2_validation": p2_validation,
    "p4_found": p4_found,
    "p4_texts": p4_texts,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
}

ORACLES: dict[str, str] = {
    "p6_roundtrip": "SELECT true AS same, count(*) AS n_docs FROM documents",
}
