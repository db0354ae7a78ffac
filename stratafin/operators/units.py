"""Quantities recorded in different units and scales, brought to one.

The records of one report (its entity) are linked across sources, which are the
strategies that read it.  Of every source its fullest record stands for it; two
sources are linked by a robust line over their shared fields (median slope,
median offset).  A link whose offset is not nought, or that no known conversion
explains, is dropped; what is left is a graph, and factors are multiplied along
its paths.  A record hangs on its own source in the same way.  The unit the
report's own text declares is pinned to the source whose label agrees (else to
the fullest) and propagates along the graph, each factor snapped to a power of
ten or to such a power between the year's currencies.  Without a statement a
record has its own label, and without a label the default; with ``linked_labels``
a record without a label takes that of a linked source if the link is a
conversion (a factor of one says nothing).

Defined results: a null value has no unit and no case; without a report id a
record stands alone; of several statements that name a unit, in one text or
many, the most frequent counts, ties by the earlier text and place; a statement
has no longest length, it ends with its sentence, at a blank line or at a
number; a factor other than one needs two shared fields; a currency without a
rate for its year gives a null value but still a case; repeated rows of one key
count once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.functions.loose import SPACE, any_of, begins, loose
from stratafin.session import stage
from stratafin.sources.tables import newest

FACTS = ("revenue", "net_profit", "profit_from_sales", "total_assets", "equity", "current_assets", "current_liabilities", "inventories", "cash_and_short_term_investments", "total_liabilities", "accounts_receivable", "capex")
#: Fields that are converted; the unit they are converted to.
FIELDS, CURRENCY, SCALE = ("revenue", "total_assets"), "RUB", 6
#: Relative distance within which an estimated scale is a known conversion.
TOLERANCE = 0.02
#: Powers of ten between recorded scales.
POWERS = (0, 3, -3, 6, -6, 9, -9)
#: Sources of a report; any other strategy counts as one more.
SOURCES = ("structured", "plain", "direct", "other")
#: OKEI codes of a rouble, a thousand and a million roubles.
OKEI = {"383": 0, "384": 3, "385": 6}

#: What opens a statement of the unit of presentation; amounts in passing have none of these.
OPENERS = (
    any_of("единиц* измерени*", "единиц* представлени*", "валют* представлени*", "валют* отчётности", "показатели отчёта", "суммы приведены", "суммы указаны", "unit of presentation", "units of presentation", "presentation currency", "reporting currency", "all amounts", "all figures", "figures:", "figures are"),
    any_of("представлен*", "приведен*", "округлен*", "составлен*", "выражен*", "указан*") + f"{SPACE}++" + any_of("в ", "до "),
    any_of("amounts are", "amounts in", "figures in", "expressed in", "presented in", "stated in"),
    rf"[(（]{SPACE}*+" + any_of("в тыс*", "в млн", "в млрд", "в миллион*", "в миллиард*", "в рубл*", "в долл*", "в евро", "в тенге", "in thousand*", "in million*", "in billion*", "in whole", "in rouble*"),
)
#: A statement: an opener and what follows up to the end of the sentence (a stop after a whole word and before a capital), a blank line or the first number (an OKEI code or ``000`` belongs to it).
_RUN = r"[^\d０-９)）.!?\n]++|(?!(?<=\p{L}{5})[.!?][\s\p{Z}]++\p{Lu})[.!?]|\n(?![^\S\n]*\n)|[0-9](?=[A-Za-zА-Яа-яЁё])|(?<=[A-Za-zА-Яа-яЁё])[0-9](?![0-9])"
#: How the openers begin: looked at first, so that most words of a text cost one look. An opening bracket is one of them.
_FIRST = begins("ед", "ва", "по", "пр", "су", "со", "ок", "вы", "ук", "un", "pr", "re", "al", "am", "fi", "ex", "st")[:-1] + "|[(（])"
STATEMENT = rf"(?<![A-Za-zА-Яа-яЁё]){_FIRST}(?:{'|'.join(OPENERS)})(?:{_RUN})*+(?:'?[0０OО][0０OО][0０OО]|[3３З][8８BВ][3-5３-５ЗS])?"

#: Words and signs of scales (powers of ten) and currencies.
SCALES = (
    (9, ("миллиард*", "млрд", "mlrd", "billion*", "bn"), r""),
    (6, ("миллион*", "млн", "million*", "mn"), r"|(?<=[A-Za-z$€] )m\b|\bM(?=RUB|USD|EUR|KZT)"),
    (3, ("тысяч*", "тыс", "thousand*"), r"|\bт\.?\s?р\b|['’]?\(?[0０][0０][0０]s?|\bk\b|\bK(?=RUB|USD|EUR|KZT)"),
)
CURRENCIES = (
    ("USD", ("долл*", "usd", "dollar*"), r"|\$"),
    ("EUR", ("евро", "euro*", "eur"), r"|€"),
    ("KZT", ("тенге", "tenge", "kzt"), r"|₸|\bтг\b"),
    ("RUB", ("рубл*", "руб", "rub", "rouble*", "ruble*"), r"|₽|\bт\.?\s?р\b|\bр\."),
)


def _spoken(words: Sequence[str], signs: str, noisy: bool) -> str:
    """A pattern for any of the words or signs; short Latin words stand alone."""
    one = loose if noisy else (lambda w: w.replace("*", "\\w*"))
    alone = [w for w in words if w in ("bn", "mn", "eur")]
    parts = [one(w) for w in words if w not in alone] + [rf"(?<!\p{{L}}){one(w)}(?!\p{{L}})" for w in alone]
    return f"(?iu){'|'.join(parts)}{signs}"


def unit_in(c: Column, noisy: bool = False) -> Column:
    """struct(currency, scale) a short text names: the scale as a power of ten; null if it names neither.

    A currency without a scale is in whole units; a scale without a currency is
    in roubles. ``noisy`` allows for what scanning and look-alikes do to words.
    """
    scale, currency = F.lit(None).cast("int"), F.lit(None).cast("string")
    for power, words, signs in reversed(SCALES):
        scale = F.when(c.rlike(_spoken(words, signs, noisy)), power).otherwise(scale)
    for code, words, signs in reversed(CURRENCIES):
        currency = F.when(c.rlike(_spoken(words, signs, noisy)), code).otherwise(currency)
    one = loose if noisy else str
    for code, power in OKEI.items():
        said = c.rlike(rf"(?iu){one('океи')}.*{one(code)}|^\s*{code}\s*$")
        scale, currency = F.when(said, power).otherwise(scale), F.when(said, "RUB").otherwise(currency)
    unit = F.struct(currency.alias("currency"), scale.alias("scale"))
    done = F.transform(F.array(unit), lambda u: F.when(u["scale"].isNotNull() | u["currency"].isNotNull(), F.struct(F.coalesce(u["currency"], F.lit("RUB")).alias("currency"), F.coalesce(u["scale"], F.lit(0)).alias("scale"))))
    return F.get(done, F.lit(0))


def declared_units(texts: DataFrame, entity: str, text: str, order: Sequence[str] = ()) -> DataFrame:
    """(entity, unit): the unit of presentation its texts declare; only entities with a statement.

    Texts are scanned where they lie; what is shuffled is one short row a
    statement. The result is staged, so the long patterns stay out of later plans.
    """
    said = F.regexp_extract_all(F.col(text), F.lit(STATEMENT), F.lit(0))
    rows = texts.filter(F.col(entity).isNotNull())
    # outer: the optimizer would else match every text a second time to see if there is a statement
    rows = rows.select(entity, *order, F.posexplode_outer(said).alias("_no", "_said")).filter("_said IS NOT NULL")
    rows = rows.select(entity, unit_in(F.col("_said"), noisy=True).alias("unit"), F.struct(*order, F.col("_no"), F.col("_said")).alias("_at")).filter("unit IS NOT NULL")
    counted = rows.groupBy(entity, "unit").agg(F.count("*").alias("_n"), F.min("_at").alias("_at"))
    return stage(counted.groupBy(entity).agg(F.min_by("unit", F.struct(-F.col("_n"), "_at")).alias("unit")))


def label_unit(label: Column, field: str) -> Column:
    """The unit a free-form label names for a field, which it may name for each field separately."""
    names = {"revenue": r"выручка|revenue", "total_assets": r"(?:итого )?активы|(?:total )?assets"}
    own, rest = names[field], "|".join(v for k, v in names.items() if k != field)
    part = F.regexp_extract(label, rf"(?iu)(?:{own})\s*[:—–-]?\s*(.*?)\s*[;,/]?\s*(?:(?:{rest})|$)", 1)
    by_field = label.rlike(rf"(?iu){own}|{rest}")
    return F.when(by_field, unit_in(part)).otherwise(unit_in(label))


def _median(values: Column) -> Column:
    v = F.array_sort(values)
    return (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2


def line_between(x: Column, h: Column) -> Column:
    """struct(n, scale, offset) of the robust line x = scale * h + offset over two arrays of the same fields.

    From three fields on the scale is the median slope between neighbours by
    ``h``, with fewer the median ratio and no offset; null parts without a
    shared field.
    """
    pairs = F.filter(F.zip_with(x, h, lambda a, b: F.struct(b.alias("h"), a.alias("x"))), lambda p: p["x"].isNotNull() & p["h"].isNotNull() & (p["h"] != 0) & (p["x"] != 0))

    def fitted(p: Column) -> Column:
        slopes = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.try_divide(F.get(p, i)["x"] - F.get(p, i - 1)["x"], F.get(p, i)["h"] - F.get(p, i - 1)["h"]))
        ratio = _median(F.transform(p, lambda q: q["x"] / q["h"]))
        scale = F.when(F.size(p) >= 3, F.coalesce(_median(F.filter(slopes, lambda v: v.isNotNull())), ratio)).when(F.size(p) > 0, ratio)
        return F.struct(F.size(p).alias("n"), scale.alias("scale"), p.alias("p"))

    def shifted(f: Column) -> Column:
        offset = F.when(f["n"] >= 3, _median(F.transform(f["p"], lambda q: q["x"] - f["scale"] * q["h"]))).when(f["n"] > 0, F.lit(0.0))
        size = _median(F.transform(f["p"], lambda q: F.abs(q["x"])))
        return F.struct(f["n"].alias("n"), f["scale"].alias("scale"), offset.alias("offset"), size.alias("size"))

    steps = F.transform(F.transform(F.transform(F.array(F.array_sort(pairs)), lambda p: p), fitted), shifted)
    return F.get(steps, F.lit(0))


def factor(x: Column, h: Column) -> Column:
    """How many times the values ``h`` the values ``x`` are, null where they are not linked: no shared
    field, an offset, or a factor other than one on a single field."""
    said = F.transform(F.array(line_between(x, h)), lambda f: F.when((F.abs(f["offset"]) <= TOLERANCE * f["size"]) & (f["scale"] > 0) & ((f["n"] >= 2) | (F.abs(f["scale"] - 1) <= TOLERANCE)), f["scale"]))
    return F.get(said, F.lit(0))


def source_graph(facts: DataFrame, entity: str, key: str = "fact_id") -> DataFrame:
    """(entity, sources, factors): the fullest record of each of an entity's sources and the factors between them.

    One aggregate a report; it holds at most one record a source, so the matrix
    of links is small and its paths are found in place, two hops at a time.
    """
    values = F.array(*FACTS)
    filled = F.size(F.filter(values, lambda v: v.isNotNull()))
    record = F.struct(filled.alias("filled"), values.alias("values"), *[label_unit(F.col("unit_label"), f).alias(f) for f in FIELDS])
    rows = facts.filter(F.col(entity).isNotNull()).select(entity, source_of("strategy").alias("_s"), F.struct(filled, -F.col(key)).alias("_o"), record.alias("_r"))
    best = [F.max_by("_r", F.when(F.col("_s") == i, F.col("_o"))).alias(f"_{i}") for i in range(len(SOURCES))]
    out = rows.groupBy(entity).agg(*best).select(entity, F.array(*[f"_{i}" for i in range(len(SOURCES))]).alias("sources"))
    at = lambda i: F.get("sources", F.lit(i))
    n = range(len(SOURCES))
    both = {(i, j): at(i)["filled"].isNotNull() & at(j)["filled"].isNotNull() for i in n for j in n if i < j}
    out = out.select(entity, "sources", *[F.when(there, factor(at(i)["values"], at(j)["values"])).alias(f"_{i}{j}") for (i, j), there in both.items()])
    cell = lambda i, j: F.col(f"_{i}{j}") if i < j else F.lit(1.0) if i == j else 1 / F.col(f"_{j}{i}")
    direct = F.array(*[F.array(*[cell(i, j) for j in n]) for i in n])
    gaps = reduce(Column.__or__, [there & F.col(f"_{i}{j}").isNull() for (i, j), there in both.items()])
    return out.select(entity, "sources", F.when(gaps, _paths(_paths(direct))).otherwise(direct).alias("factors"))


def _paths(factors: Column) -> Column:
    """A matrix of factors with its gaps filled by paths of twice as many links."""
    n = F.sequence(F.lit(0), F.lit(len(SOURCES) - 1))

    def closed(m: Column) -> Column:
        by = lambda i, j: F.get(F.filter(F.transform(n, lambda k: F.get(F.get(m, i), k) * F.get(F.get(m, k), j)), lambda f: f.isNotNull()), F.lit(0))
        return F.transform(n, lambda i: F.transform(n, lambda j: F.coalesce(F.get(F.get(m, i), j), by(i, j))))

    return F.get(F.transform(F.array(factors), closed), F.lit(0))


def source_of(strategy: str) -> Column:
    """The place of a strategy among ``SOURCES``."""
    at = F.array_position(F.array(*map(F.lit, SOURCES[:-1])), F.coalesce(strategy, F.lit("")))
    return F.when(at > 0, at - 1).otherwise(len(SOURCES) - 1).cast("int")


def unit_along(unit: Column, times: Column, rates: Column) -> Column:
    """The known unit of values ``times`` as large as the same quantities in ``unit``; null if none is near.

    The same currency first, then the others by the year's ``rates`` (a map).
    """

    def known(currency: Column, factor: Column) -> Column:
        power = F.round(F.log10(factor)).cast("int")
        near = power.isin(*POWERS) & (F.abs(factor / F.pow(F.lit(10.0), power) - 1) <= TOLERANCE)
        return F.when(near, F.struct(currency.alias("currency"), (unit["scale"] - power).alias("scale")))

    rate = lambda c: F.when(c == CURRENCY, F.lit(1.0)).otherwise(F.try_element_at(rates, c))
    others = [known(F.lit(c), times * rate(F.lit(c)) / rate(unit["currency"])) for c, *_ in CURRENCIES]
    return F.coalesce(known(unit["currency"], times), *others)


def yearly(rates: DataFrame) -> DataFrame:
    """(period_year, rates): one map a year, currency to roubles."""
    each = rates.filter("currency IS NOT NULL AND rub_per_unit IS NOT NULL").groupBy("period_year", "currency").agg(F.max("rub_per_unit").alias("r"))
    return each.groupBy("period_year").agg(F.map_from_entries(F.collect_list(F.struct("currency", "r"))).alias("_rates"))


def common_units(facts: DataFrame, texts: DataFrame, rates: DataFrame, order: Sequence[str] = (), linked_labels: bool = False) -> DataFrame:
    """One row a fact record and field: its unit, what told it, and the value in million roubles.

    ``facts`` holds fact_id, doc_id, period_year, strategy, the fact fields and
    unit_label; ``texts`` doc_id and text; ``rates`` currency, period_year and
    rub_per_unit. Records without a report take no part in the joins by report.
    """
    facts = newest(facts, "fact_id", "ingested_at", "doc_id", "period_year", "strategy", "unit_label", "ingested_at", *FACTS)
    said = declared_units(texts, "doc_id", "text", order).withColumnRenamed("unit", "_said")
    told = source_graph(facts, "doc_id").join(said.hint("merge"), "doc_id", "left")
    linked = facts.filter("doc_id IS NOT NULL").join(told.hint("merge"), "doc_id").unionByName(facts.filter("doc_id IS NULL"), allowMissingColumns=True)
    linked = linked.join(yearly(rates), "period_year", "left").withColumn("_i", source_of("strategy"))
    own = F.get("sources", F.col("_i"))
    values = F.array(*FACTS)
    linked = linked.withColumn("_own", F.when(values.eqNullSafe(own["values"]), 1.0).otherwise(factor(values, own["values"]))).withColumn("_row", F.get("factors", F.col("_i")))
    n = F.sequence(F.lit(0), F.lit(len(SOURCES) - 1))
    fullest = F.array_position(F.transform("sources", lambda s: s["filled"]), F.array_max(F.transform("sources", lambda s: s["filled"]))).cast("int") - 1
    cells = []
    for f in FIELDS:
        agrees = F.get(F.filter(n, lambda k: F.get("sources", k)[f] == F.col("_said")), F.lit(0))
        by_link = F.filter(F.transform(n, lambda k: F.struct(F.get("sources", k)[f].alias("u"), unit_along(F.get("sources", k)[f], F.col("_own") * F.get("_row", k), F.col("_rates")).alias("v"))), lambda x: x["v"].isNotNull() & (x["v"] != x["u"]))
        alone = F.lit(linked_labels) & F.col("_said").isNull() & F.col(f"_label_{f}").isNull()
        cells.append(F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"_label_{f}").alias("label"), F.coalesce(agrees, fullest).alias("pin"), F.when(alone, F.get(F.transform(by_link, lambda x: x["v"]), F.lit(0))).alias("by_link")))
    linked = linked.withColumns({f"_label_{f}": label_unit(F.col("unit_label"), f) for f in FIELDS})
    rows = linked.select("fact_id", "_said", "_own", "_row", "_rates", F.inline(F.array(*cells))).filter("value IS NOT NULL")
    along = F.coalesce(unit_along(F.col("_said"), F.col("_own") * F.get("_row", F.col("pin")), F.col("_rates")), F.col("_said"))
    default = F.struct(F.lit(CURRENCY).alias("currency"), F.lit(SCALE).alias("scale"))
    unit = F.when(F.col("_said").isNotNull(), along).otherwise(F.coalesce("label", "by_link", default))
    basis = F.when(F.col("_said").isNotNull(), "text").when(F.col("label").isNotNull(), "label").when(F.col("by_link").isNotNull(), "link").otherwise("default")
    rows = rows.select("fact_id", "field", "value", "_rates", unit.alias("_u"), basis.alias("basis")).select("fact_id", "field", "value", "_rates", "_u.currency", "_u.scale", "basis")
    rate = F.when(F.col("currency") == CURRENCY, 1.0).otherwise(F.try_element_at("_rates", F.col("currency")))
    return rows.select("fact_id", "field", "value", "currency", "scale", "basis", (F.col("value") * F.pow(F.lit(10.0), F.col("scale") - SCALE) * rate).alias("value_mln_rub"))


def in_other_units(converted: DataFrame) -> DataFrame:
    """(fact_id, field) of the values not recorded in million roubles."""
    return converted.filter((F.col("currency") != CURRENCY) | (F.col("scale") != SCALE)).select("fact_id", "field")
