"""Reading order, line grouping and numeric tables of recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions import text as T

#: Height of a reading band, tolerance of a line's height, weight of the new height, width of a column step (pixels).
BAND, LINE, WEIGHT, STEP = 10.0, 6.0, 0.3, 100.0


def box_position(polygon: Column) -> Column:
    """struct(y, x) of a polygon: mean height and least x; null for one that is missing or malformed."""
    sound = (F.size(polygon) > 0) & F.forall(polygon, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    ys = F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    mean = F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size(ys)
    return F.when(sound, F.struct(mean.alias("y"), F.array_min(F.transform(polygon, lambda p: F.get(p, F.lit(0)))).alias("x")))


def reading_order(items: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """``items`` (keys, pos, y, x, text) with ``ord``: by bands of height, then x, then as given; those without a box last."""
    w = Window.partitionBy(*keys).orderBy(F.col("y").isNull(), F.floor(F.col("y") / BAND), "x", pos)
    return items.withColumn("ord", F.row_number().over(w))


def group_lines(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, text, y): the lines of ordered items.

    An item joins the line whose running height is within ``LINE`` unless it
    lies more than ``STEP`` from the line's first x; then it opens a line of the
    same height. A fold over a page's items; an item without a box is a line.
    """
    item = F.struct("ord", "y", "x", "text")
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("y"), none.alias("x"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<struct<text:string,y:double>>").alias("done"))

    def flushed(s: Column) -> Column:
        line = F.struct(F.array_join(s["parts"], "  ").alias("text"), s["y"].alias("y"))
        return F.when(F.size(s["parts"]) > 0, F.concat(s["done"], F.array(line))).otherwise(s["done"])

    def state(y: Column, x: Column, parts: Column, done: Column) -> Column:
        return F.struct(y.alias("y"), x.alias("x"), parts.alias("parts"), done.alias("done"))

    def step(s: Column, i: Column) -> Column:
        same = i["y"].isNotNull() & (s["y"].isNull() & (F.size(s["parts"]) == 0) | (F.abs(i["y"] - s["y"]) <= LINE))
        beside = s["x"].isNotNull() & (F.abs(i["x"] - s["x"]) > STEP)
        moved = F.when(s["y"].isNull(), i["y"]).otherwise(s["y"] * (1 - WEIGHT) + i["y"] * WEIGHT)
        joined = state(moved, F.coalesce(s["x"], i["x"]), F.concat(s["parts"], F.array(i["text"])), s["done"])
        column = state(s["y"], i["x"], F.array(i["text"]), flushed(s))
        fresh = state(i["y"], i["x"], F.array(i["text"]), flushed(s))
        return F.when(F.coalesce(same, F.lit(False)) & F.coalesce(beside, F.lit(False)) & (F.size(s["parts"]) > 0), column).when(F.coalesce(same, F.lit(False)), joined).otherwise(fresh)

    out = items.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_i")).select(*keys, F.aggregate("_i", start, step, flushed).alias("_l"))
    return out.select(*keys, F.posexplode("_l").alias("_n", "_x")).select(*keys, (F.col("_n") + 1).alias("line_no"), "_x.text", "_x.y")


def single_page_text(items: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, text): the items of a page (pos, y, x, text) as lines, for pages that are read one by one.

    Ordered by exact height, then x; parts of a line stand one space apart and
    no columns are told apart; items without a box come last, each a line.
    """
    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<string>").alias("done"))
    flushed = lambda s: F.when(F.size(s["parts"]) > 0, F.concat(s["done"], F.array(F.array_join(s["parts"], " ")))).otherwise(s["done"])

    def step(s: Column, i: Column) -> Column:
        first = F.size(s["parts"]) == 0
        same = F.coalesce(first | (F.abs(i["y"] - s["y"]) <= LINE), F.lit(False))
        moved = F.when(first, i["y"]).otherwise(s["y"] * (1 - WEIGHT) + i["y"] * WEIGHT)
        joined = F.struct(moved.alias("y"), F.concat(s["parts"], F.array(i["text"])).alias("parts"), s["done"].alias("done"))
        return F.when(same, joined).otherwise(F.struct(i["y"].alias("y"), F.array(i["text"]).alias("parts"), flushed(s).alias("done")))

    said = items.withColumn("text", T.strip(F.col("text"))).filter("text <> ''")
    item = F.struct(F.col("y").isNull().alias("last"), "y", "x", pos, "text")
    lines = F.aggregate(F.array_sort(F.collect_list(item)), start, step, flushed)
    text = F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]{2,}", " "), F.lit(T.WHITE))
    return said.groupBy(*keys).agg(F.regexp_replace(text, r"<br ?/?>", " ").alias("text"))


def table_regions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` (keys, line_no, line) with ``region``: the first line of the run of table rows a line is in, null outside runs of two or more."""
    row = T.is_table_row(F.col("line"))
    order = Window.partitionBy(*keys).orderBy("line_no")
    island = F.when(row, F.col("line_no") - F.sum(row.cast("int")).over(order))
    df = lines.withColumn("_row", row).withColumn("_island", island)
    w = Window.partitionBy(*keys, "_island")
    inside = F.col("_row") & (F.count("*").over(w) >= 2)
    return df.withColumn("region", F.when(inside, F.min("line_no").over(w))).drop("_row", "_island")


def repair_tables(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, text): numeric runs re-formatted as aligned tables, blanks collapsed in other lines with digits."""
    rows = texts.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    rows = table_regions(rows, keys).withColumn("_cells", F.when(F.col("region").isNotNull(), T.cells(F.col("line"))))
    width = F.max(F.size("_cells")).over(Window.partitionBy(*keys, "region"))
    padded = F.concat("_cells", F.array_repeat(F.lit(""), F.greatest(width - F.size("_cells"), F.lit(0))))
    table = F.rtrim(F.array_join(F.transform(padded, lambda c: T.right_aligned(T.grouped(c))), " | "))
    done = F.when(F.col("region").isNotNull(), table).otherwise(T.collapse_numbers(F.col("line")))
    listed = F.array_sort(F.collect_list(F.struct("line_no", F.coalesce(F.col("done"), F.lit("")).alias("line"))))
    return rows.withColumn("done", done).groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))
