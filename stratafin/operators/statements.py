"""Lines of statements to facts.

Ordering is an explicit column (``line_no``), never the order of partitions.  A
report's rows meet by ``doc_id``; only its header and page lines are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions import text as T

#: The facts and the phrases whose line holds them (lower-case substrings).
PHRASES = {
    "revenue": ("выручка", "revenue", "выручка от реализации"),
    "net_profit": ("чистая прибыль", "прибыль за год", "net profit"),
    "profit_from_sales": ("операционная прибыль", "прибыль от продаж", "прибыль от основной", "operating profit"),
    "total_assets": ("итого активы", "всего активов", "total assets", "активы всего"),
    "equity": ("капитал и резервы", "собственный капитал", "итого капитал", "total equity"),
    "current_assets": ("оборотные активы", "current assets"),
    "current_liabilities": ("краткосрочные обязательства", "краткосрочные пассивы", "current liabilities"),
    "inventories": ("запасы", "inventories"),
    "cash_and_short_term_investments": ("денежные средства", "денежные средства и их эквиваленты", "краткосрочные финансовые вложения"),
    "total_liabilities": ("итого обязательства", "итого пассивы", "total liabilities"),
    "accounts_receivable": ("дебиторская задолженность", "accounts receivable"),
    "capex": ("приобретение основных средств", "приобретение внеоборотных активов", "покупка основных средств", "capex"),
}
FIELDS = tuple(PHRASES)


def numbered_lines(df: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """(key, line_no, line): the non-blank lines of a document's rows in the given order, counted from 1.

    Rows without a key belong to no document and are left out.
    """
    rows = df.filter(F.col(key).isNotNull()).select(key, *order, F.posexplode(T.lines(F.col(text))).alias("_at", "line"))
    w = Window.partitionBy(key).orderBy(*order, "_at")
    return rows.select(key, F.row_number().over(w).cast("bigint").alias("line_no"), "line")


def structured_lines(pages: DataFrame, key: str, content: str = "content", order: tuple[str, ...] = ("page_number", "block_no"), fallback: DataFrame | None = None) -> DataFrame:
    """Lines of page blocks; documents of ``fallback`` (key, text) without any line there give those of their text."""
    main = numbered_lines(pages, key, content, list(order))
    if fallback is None:
        return main
    rest = fallback.join(main.select(key).distinct(), key, "left_anti")
    return main.union(numbered_lines(rest.withColumn("_p", F.lit(0)), key, "text", ["_p"]))


def matches(line: Column, field: str) -> Column:
    """Any phrase of a field is within the lower-case line."""
    low = F.lower(line)
    out = F.lit(False)
    for phrase in PHRASES[field]:
        out = out | F.contains(low, F.lit(phrase))
    return out


def keyword_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """One row a line and field it speaks of: an unrolled substring join against the small dictionary."""
    hits = F.array_compact(F.array(*[F.when(matches(F.col(line), f), F.lit(f)) for f in FIELDS]))
    return df.select("*", F.explode(hits).alias("field"))


def with_year_context(df: DataFrame, key: str = "doc_id", reset_per_page: str | None = None) -> DataFrame:
    """``df`` (key, line_no, line) with years, numbers, ``is_header`` and the year columns in force.

    A header replaces the context by its years that were not in it, so the same
    header again clears it; a page line clears it and is itself read without.
    ``reset_per_page`` names a column whose change also clears it.

    Only header and page lines are folded, once a document; what each leaves in
    force joins the lines as a row of its own and is carried forward, so the
    work grows with the lines and not with lines times headers.
    """
    line = F.col("line")
    rows = df.withColumn("years", T.years(line)).withColumn("numbers", T.numbers(line))
    rows = rows.withColumn("is_header", T.is_year_header(line, F.col("years"), F.col("numbers")))
    event = F.when(F.col("is_header"), F.col("years")).when(T.is_page_break(line), F.array().cast("array<int>"))
    keys = [key, reset_per_page] if reset_per_page else [key]
    may_be = line.rlike(r"20[0-9]{2}(?s:.*)20[0-9]{2}") | T.is_page_break(line)  # asked first: most lines are then not searched for numbers
    events = rows.filter(may_be).withColumn("_e", event).filter("_e IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "_e"))).alias("_es"))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("now"), F.array().cast("array<struct<line_no:bigint,context:array<int>>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        kept = F.filter(e["_e"], lambda y: ~F.array_contains(acc["now"], y))
        return F.struct(kept.alias("now"), F.concat(acc["out"], F.array(F.struct(e["line_no"].cast("bigint").alias("line_no"), kept.alias("context")))).alias("out"))

    folded = events.select(*keys, F.inline(F.aggregate("_es", start, step, lambda acc: acc["out"])))
    both = rows.withColumn("_told", F.lit(None).cast("array<int>")).unionByName(folded.select(*keys, F.col("line_no").cast(df.schema["line_no"].dataType), F.col("context").alias("_told")), allowMissingColumns=True)
    ordered = Window.partitionBy(*keys).orderBy("line_no", F.col("_told").isNull())
    in_force = F.last("_told", ignorenulls=True).over(ordered)
    return both.withColumn("context", F.coalesce(in_force, none)).filter("_told IS NULL").drop("_told")


def value_by_column(line: Column, context: Column) -> Column:
    """The number in the column of the latest year, else the last number; null for fewer than two columns."""
    cols = T.columns(line)
    firsts = F.transform(cols, lambda c: F.get(T.numbers(c), F.lit(0)))
    return _pick(cols, firsts, context)


def _pick(cols: Column, firsts: Column, context: Column) -> Column:
    cells = F.when(F.get(firsts, F.lit(0)).isNull(), F.slice(firsts, 2, F.size(firsts))).otherwise(firsts)
    known = F.filter(cells, lambda x: x.isNotNull())
    at = F.array_position(context, F.array_max(context)).cast("int") - 1
    aligned = F.when((F.size(context) > 0) & (F.size(context) <= F.size(cells)), F.get(cells, at))
    return F.when((F.size(cols) >= 2) & (F.size(known) > 0), F.coalesce(aligned, F.try_element_at(known, F.lit(-1))))


def value_by_year(found: Column, context: Column) -> Column:
    """From a flat list of numbers: years left out unless nothing else is there; that of the latest year, else the first."""
    other = F.filter(found, lambda n: ~F.exists(context, lambda y: (n >= y) & (n < y + 1)))
    kept = F.when((F.size(context) > 0) & (F.size(other) > 0), other).otherwise(found)
    at = F.array_position(context, F.array_max(context)).cast("int") - 1
    return F.coalesce(F.when(F.size(context) > 0, F.get(kept, at)), F.get(kept, F.lit(0)))


def _valued(df: DataFrame, **how) -> DataFrame:
    rows = with_year_context(df, **how).withColumn("_cols", T.columns(F.col("line")))
    rows = rows.withColumn("_firsts", F.transform("_cols", lambda c: F.get(T.numbers(c), F.lit(0))))
    value = F.coalesce(_pick(F.col("_cols"), F.col("_firsts"), F.col("context")), value_by_year(F.col("numbers"), F.col("context")))
    return rows.withColumn("value", F.when(~F.col("is_header"), value)).drop("_cols", "_firsts")


def with_values(df: DataFrame, **how) -> DataFrame:
    """Lines with the value each stands for; header lines are gone, lines without a number have null."""
    return _valued(df, **how).filter(~F.col("is_header"))


def extract_facts(df: DataFrame, key: str = "doc_id", count: str | None = None, **how) -> DataFrame:
    """One row a document with the twelve facts: of a field's lines with a value the last one counts.

    One aggregate with map-side combine over lines that are read once; every
    document with a line has a row. ``count`` names a column for its number of lines.
    """
    rows = _valued(df, key=key, **how)
    speaks = lambda f: F.when(matches(F.col("line"), f) & F.col("value").isNotNull(), F.col("line_no"))
    more = [F.count("*").alias(count)] if count else []
    return rows.groupBy(key).agg(*more, *[F.max_by("value", speaks(f)).alias(f) for f in FIELDS])


def preview_lines(df: DataFrame, n: int = 80) -> DataFrame:
    """The first ``n`` lines of every document, by their number."""
    return df.filter(F.col("line_no") <= n)


def record_lines(records: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, line_no, line): the lines of ``nested.unnest``'s blocks in the order of the document, counted from 1."""
    place = F.split("b.path", r"\.").cast("array<int>")
    # outer: the optimizer would else walk every record a second time to see if there is a block
    rows = records.select(key, F.explode_outer("block_rows").alias("b")).filter("b.content IS NOT NULL").select(key, place.alias("_p"), F.md5("b.content").alias("_c"), F.col("b.content").alias("content"))
    return numbered_lines(rows, key, "content", ["_p", "_c"])  # objects that are no array's share a place
