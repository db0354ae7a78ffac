"""Writers of results: texts, JSON, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_texts(texts: DataFrame, path: str, key: str = "doc_id", text: str = "text", folders: bool = False) -> None:
    """Texts by their key as JSON lines, as many files as tasks; ``folders`` writes one folder a document with its plain text (for few documents)."""
    rows = texts.select(key, F.col(text).alias("text"))
    if folders:
        rows.withColumnRenamed("text", "value").write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)
    else:
        write_json(rows, path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def artifact_name(name: str, stamp: str, max_pages: int | None = None) -> str:
    """The name of a stored extraction: of all pages or the first so many."""
    return f"extracted_{name}_{'all' if max_pages is None else f'first{max_pages}'}_{stamp}"


def write_reports(rows: DataFrame, write: Callable[[str, list[Row]], None], key: str = "doc_id") -> None:
    """Hands each report's ordered rows to ``write(document, rows)`` where they lie; a writer may need packages of its own."""
    ordered = rows.repartition(key).sortWithinPartitions(key, "section", "ord")

    def each(part: Iterator[Row]) -> None:
        now, held = None, []
        for r in part:
            if r[key] != now and held:
                write(now, held)
                held = []
            now = r[key]
            held.append(r)
        if held:
            write(now, held)

    ordered.foreachPartition(each)
