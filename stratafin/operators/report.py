"""Rows of an analysis report and texts of recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.functions import text as T
from stratafin.operators import ratios

#: Headings of the report, the row a preview puts first.
TITLE = "Финансовый отчёт (автоанализ)"
HEADS = ("Статус", "Показатель", "Значение", "Формула")
BALANCE = ("balance", "Баланс", "активы = пасивы", "", "ok")
#: Members of a recommendation and the words before them.
MEMBERS = (("рекомендация", "Рекомендация"), ("значение", "Текущее значение"), ("норма", "Норма"))


def with_balance_first(metrics: DataFrame, key: str = "doc_id") -> DataFrame:
    """Displayed metrics with the balance row in front of documents that name none; only for previews."""
    named = F.max(F.lower("metric").contains("balance") | F.lower("title").contains("баланс"))
    lacking = metrics.groupBy(key).agg(named.alias("_n")).filter(~F.col("_n")).select(key)
    k, title, formula, display, status = BALANCE
    row = lacking.select(key, F.lit(0).alias("ord"), F.lit(k).alias("metric"), F.lit(title).alias("title"), F.lit(formula).alias("formula"), F.lit(display).alias("display"), F.lit(status).alias("status"))
    return metrics.select(*row.columns).unionByName(row)


def report_rows(reports: DataFrame, recommendations: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, section, ord, cells): reports as ordered rows, ready for a writer.

    ``reports`` holds one row a document: key, file_name, date, the facts and
    perhaps a text of recommendations. Its rows are made as one array and come
    out by one inline; nothing is shuffled.
    """
    row = lambda section, ord_, *cells: F.struct(F.lit(section).alias("section"), ord_.cast("int").alias("ord"), F.array(*cells).alias("cells"))
    told = ratios.warning_texts()
    head = [row(1, F.lit(0), F.lit(TITLE)), row(2, F.lit(0), F.concat(F.lit("Файл: "), F.col("file_name"))), row(2, F.lit(1), F.concat(F.lit("Дата: "), F.col("date"))), row(4, F.lit(0), *map(F.lit, HEADS))]
    listed = lambda section, title, texts, mark: F.when(F.size(texts) > 0, F.concat(F.array(row(section, F.lit(0), F.lit(title))), F.transform(texts, lambda x, i: row(section, i + 1, F.concat(F.lit(mark), x)))))
    none = F.slice(F.array(head[0]), 1, 0)
    parts = [F.array(*head), F.coalesce(listed(3, "Предупреждения", told, "• "), none), F.transform("_metrics", lambda m: row(4, m["ord"], ratios.status_sign(m["status"]), m["title"], m["display"], m["formula"]))]
    if recommendations:
        lines = F.filter(F.transform(F.split(T.xml_escaped(F.col(recommendations)), "\n"), T.strip), lambda x: x != "")
        parts.append(F.coalesce(listed(5, "Рекомендации", lines, ""), none))
    return ratios.shown_metrics(reports, "_metrics").select(key, F.inline(F.concat(*parts)))


def recommendation_text(raw: Column) -> Column:
    """Recommendations as text: plain text as it is, a JSON list of strings as lines, of objects as numbered entries."""
    v = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit(',"end":true}')))
    items = F.when(F.try_variant_get(v, "$.end", "boolean"), F.try_variant_get(v, "$.v", "array<variant>"))
    of = lambda x, k: F.try_variant_get(x, f"$['{k}']", "string")

    def entry(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        (k0, w0), *more = MEMBERS
        head = F.concat(n, F.lit(". "), F.coalesce(of(x, "параметр"), F.concat(F.lit("Рекомендация "), n)))
        said = F.concat(F.lit(f"   {w0}: "), F.coalesce(of(x, k0), F.lit("")))
        rest = [F.when(F.coalesce(of(x, k), F.lit("")) != "", F.concat(F.lit(f"   {w}: "), of(x, k))) for k, w in more]
        return F.array_join(F.array_compact(F.array(head, said, *rest, F.lit(""))), "\n")

    objects = F.startswith(F.to_json(F.get(items, F.lit(0))), F.lit("{"))
    listed = F.array_join(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), "\n")
    return F.when(items.isNull(), raw).when(F.coalesce(objects, F.lit(False)), F.array_join(F.transform(items, entry), "\n")).otherwise(listed)
