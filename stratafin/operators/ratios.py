"""Twelve ratios of a row of facts, their statuses, warnings and texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Key, title, formula in words, unit, hint, bounds for ok and warn, whether a smaller value is better.
RATIOS = (
    ("ros", "Рентабельность продаж", "Прибыль от продаж / Выручка", "%", "Доля операционной прибыли в выручке.", 0.15, 0.05, False),
    ("net_margin", "Рентабельность чистой прибыли", "Чистая прибыль / Выручка", "%", "Сколько чистой прибыли с рубля выручки.", 0.10, 0.03, False),
    ("roa", "ROA", "Чистая прибыль / Активы", "%", "Эффективность использования активов.", 0.08, 0.03, False),
    ("roe", "ROE", "Чистая прибыль / Собственный капитал", "%", "Доходность капитала для владельцев.", 0.08, 0.03, False),
    ("current_ratio", "Текущая ликвидность", "Оборотные активы / Краткосрочные обязательства", "раз", "Покрытие краткосрочных долгов оборотными активами.", 1.5, 1.0, False),
    ("quick_ratio", "Быстрая ликвидность", "(Оборотные активы − Запасы) / Краткосрочные обязательства", "раз", "Ликвидность без запасов.", 1.0, 0.7, False),
    ("cash_ratio", "Денежная ликвидность", "(Деньги + краткоср. вложения) / Краткосрочные обязательства", "раз", "Мгновенная платёжеспособность.", 0.2, 0.1, False),
    ("autonomy", "Автономия", "Собственный капитал / Активы", "доля", "Доля собственных средств в активах.", 0.5, 0.33, False),
    ("leverage", "Финансовый леверидж", "Обязательства / Собственный капитал", "раз", "Долг на рубль собственного капитала.", 1.0, 2.5, True),
    ("dso", "Оборачиваемость дебиторки (дни)", "(Дебиторка / Выручка) × 365", "дни", "Средний срок погашения дебиторки.", 45.0, 90.0, True),
    ("asset_turnover", "Оборачиваемость активов", "Выручка / Активы", "раз", "Выручка на рубль активов.", 0.5, 0.3, False),
    ("capex_revenue", "CAPEX / Выручка", "Приобретение ОС / Выручка", "%", "Доля инвестиций в основные средства от выручки.", 0.25, 0.40, True),
)
#: The facts of a summary in their order.
SUMMARY = ("profit_from_sales", "revenue", "net_profit", "total_assets", "equity", "current_assets", "current_liabilities", "inventories", "cash_and_short_term_investments", "total_liabilities", "accounts_receivable", "capex")
#: The sign of a status, any other text.
SIGNS = {"ok": "🟢", "warn": "🟡", "risk": "🔴"}
#: Facts without which a warning is due, in order; the texts of warnings.
CORE = ("revenue", "net_profit", "total_assets", "equity")
MISSING = "Нет показателя «{}» — часть метрик будет пропущена. Добавьте строку в отчёт или введите вручную."
NO_LIABILITIES = "Для ликвидности нужны краткосрочные обязательства."
NO_SALES_PROFIT = "Нет «прибыль от продаж / операционная прибыль» — рентабельность продаж не посчитана."
NO_INVENTORIES = "Нет строки «Запасы» — быстрая ликвидность не посчитана."


def ratio(key: str) -> Column:
    """A ratio over the fact columns: null if a part is unknown or the denominator is zero."""
    c = F.col
    parts = {
        "ros": (c("profit_from_sales"), c("revenue")),
        "net_margin": (c("net_profit"), c("revenue")),
        "roa": (c("net_profit"), c("total_assets")),
        "roe": (c("net_profit"), c("equity")),
        "current_ratio": (c("current_assets"), c("current_liabilities")),
        "quick_ratio": (c("current_assets") - c("inventories"), c("current_liabilities")),
        "cash_ratio": (c("cash_and_short_term_investments"), c("current_liabilities")),
        "autonomy": (c("equity"), c("total_assets")),
        "leverage": (c("total_liabilities"), c("equity")),
        "dso": (c("accounts_receivable"), c("revenue")),
        "asset_turnover": (c("revenue"), c("total_assets")),
        "capex_revenue": (c("capex"), c("revenue")),
    }
    value = F.try_divide(*parts[key])
    return value * 365.0 if key == "dso" else value


def status(value: Column, ok: float, warn: float, smaller: bool) -> Column:
    """ok, warn or risk by bounds that belong to the better side; na for null."""
    good, fair = (value <= ok, value <= warn) if smaller else (value >= ok, value >= warn)
    return F.when(value.isNull(), "na").when(good, "ok").when(fair, "warn").otherwise("risk")


def status_sign(c: Column) -> Column:
    out = F.lit("⚪")
    for k, v in SIGNS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def metrics(facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Twelve rows a document: key, ord, metric, title, formula, value, unit, status, hint.

    One narrow projection: an array of twelve structs is exploded.
    """
    wide = facts.select(key, *[ratio(r[0]).alias(f"_{r[0]}") for r in RATIOS])
    rows = [
        F.struct(F.lit(i).alias("ord"), F.lit(k).alias("metric"), F.lit(title).alias("title"), F.lit(formula).alias("formula"), F.col(f"_{k}").alias("value"), F.lit(unit).alias("unit"), status(F.col(f"_{k}"), ok, warn, smaller).alias("status"), F.lit(hint).alias("hint"))
        for i, (k, title, formula, unit, hint, ok, warn, smaller) in enumerate(RATIOS, 1)
    ]
    return wide.select(key, F.inline(F.array(*rows)))


@F.pandas_udf(StringType())
def _fixed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Decimal text of the double's true value, ties to even: what no built-in format gives."""
    for value, places in parts:
        yield pd.Series([None if pd.isna(v) else f"{v:.{int(p)}f}" for v, p in zip(value, places)], dtype="object")


@F.pandas_udf(ArrayType(StringType()))
def _fixed_all(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``_fixed`` for the values of all ratios of a row, in their order."""
    places = [0 if r[0] == "dso" else 2 for r in RATIOS]
    for values in rows:
        yield pd.Series([[None if pd.isna(v) else f"{v:.{p}f}" for v, p in zip(row, places)] for row in values], dtype="object")


def shown_metrics(facts: DataFrame, name: str = "metrics") -> DataFrame:
    """``facts`` with an array of its twelve displayed metrics: one projection, one call of Python a batch."""
    wide = facts.withColumns({f"_{r[0]}": ratio(r[0]) for r in RATIOS})
    wide = wide.withColumn("_texts", _fixed_all(F.array(*[F.col(f"_{r[0]}") * (100.0 if r[3] == "%" else 1.0) for r in RATIOS])))
    items = []
    for i, (k, title, formula, unit, hint, ok, warn, smaller) in enumerate(RATIOS):
        tail = "%" if unit == "%" else " дн." if k == "dso" else ""
        shown = F.coalesce(F.concat(F.get("_texts", F.lit(i)), F.lit(tail)), F.lit("—"))
        fixed = {"ord": F.lit(i + 1), "metric": F.lit(k), "title": F.lit(title), "formula": F.lit(formula), "value": F.col(f"_{k}"), "display": shown, "unit": F.lit(unit), "status": status(F.col(f"_{k}"), ok, warn, smaller), "hint": F.lit(hint)}
        items.append(F.struct(*[c.alias(n) for n, c in fixed.items()]))
    return wide.withColumn(name, F.array(*items)).drop("_texts", *[f"_{r[0]}" for r in RATIOS])


def displayed(rows: DataFrame) -> DataFrame:
    """``metrics`` with ``display``: percents with two places, days with none, a dash for null."""
    percent, days = F.col("unit") == "%", F.col("metric") == "dso"
    text = _fixed(F.when(percent, F.col("value") * 100).otherwise(F.col("value")), F.when(days, 0).otherwise(2))
    tail = F.when(percent, "%").when(days, " дн.").otherwise("")
    return rows.withColumn("display", F.coalesce(F.concat(text, tail), F.lit("—")))


def coefficients(rows: DataFrame) -> DataFrame:
    """The known values of ``metrics`` by title, percents times 100, four places."""
    value = F.when(F.col("unit") == "%", F.col("value") * 100).otherwise(F.col("value"))
    return rows.filter(F.col("value").isNotNull()).withColumn("coefficient", F.round(value, 4))


def coefficient_map(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One map a document, title to coefficient, in the order of the metrics."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "title", "coefficient")))
    return coefficients(rows).groupBy(key).agg(F.map_from_entries(F.transform(listed, lambda x: F.struct(x["title"], x["coefficient"]))).alias("coefficients"))


def warning_texts() -> Column:
    """The ordered warnings of a row of facts."""
    gone, there = (lambda f: F.col(f).isNull()), (lambda f: F.col(f).isNotNull())
    rules = [(gone(f), MISSING.format(f)) for f in CORE]
    rules.append((there("current_assets") & gone("current_liabilities"), NO_LIABILITIES))
    rules.append((gone("profit_from_sales"), NO_SALES_PROFIT))
    rules.append((there("current_assets") & there("current_liabilities") & gone("inventories"), NO_INVENTORIES))
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in rules]))


def warnings(facts: DataFrame, key: str = "doc_id") -> DataFrame:
    return facts.select(key, F.posexplode(warning_texts()).alias("ord", "warning"))


def plain_double(c: Column) -> Column:
    """A double as plain decimals with at least one place (for 1e-3 up to below 1e16; beyond that as the engine writes it)."""
    wide = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    return F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), wide).otherwise(c.cast("string"))


def facts_summary(facts: DataFrame, key: str = "doc_id", order: tuple[str, ...] = SUMMARY) -> DataFrame:
    """``name=value`` of the known facts, or a text that none was extracted."""
    known = F.concat_ws("; ", *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}="), plain_double(F.col(f)))) for f in order])
    return facts.select(key, F.when(known == "", "данные не извлечены").otherwise(known).alias("summary"))


def metrics_prompt(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The lines of a document's displayed metrics for a prompt."""
    line = F.concat(F.lit("- "), "title", F.lit(": "), "display", F.lit(" ("), "status", F.lit(") — "), "hint")
    listed = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("prompt"))
