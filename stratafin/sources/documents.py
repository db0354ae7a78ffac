"""Readers of documents: text, stored results, PDF by optional decoders."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafin.functions import jsons
from stratafin.functions import text as T
from stratafin.operators import layout, pages

#: Decoders of PDF text that are tried in order.
DECODERS = ("pypdf", "pdfplumber", "fitz")
RESULT = "metadata struct<extraction_date:string,surya_version:string,parsers_used:array<string>,torch_available:boolean,gpu_available:boolean,compute_device:string,cuda_visible_devices:string>, stats struct<total_pages:int,extracted_pages:int,coverage_percent:double,methods:array<string>,total_chars:bigint,total_tables:bigint,avg_confidence:double>, pages array<struct<page_number:int,method:string,confidence:double,char_count:int,blocks:array<struct<type:string,content:string,y:double>>,error:string>>"
BOXES = "array<struct<text_lines:array<struct<text:string,polygon:array<array<double>>>>>>"


def available_decoders() -> list[str]:
    return [d for d in DECODERS if importlib.util.find_spec(d)]


def pdf_pages(content: bytes) -> list[str]:
    """Texts of a PDF's pages by the first decoder that can read it."""
    for name in available_decoders():
        try:
            if name == "pypdf":
                import pypdf

                return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
            if name == "pdfplumber":
                import pdfplumber

                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    return [p.extract_text() or "" for p in pdf.pages]
            import fitz

            return [p.get_text() or "" for p in fitz.open(stream=content, filetype="pdf")]
        except Exception:  # noqa: BLE001, S112
            continue
    return []


def pdf_page_count(content: bytes) -> int:
    """Number of pages by the first decoder that can read the file, 0 if none can."""
    for name in ("fitz", "pdfplumber"):
        try:
            if name == "fitz":
                import fitz

                with fitz.open(stream=content, filetype="pdf") as doc:
                    return doc.page_count
            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as pdf:
                return len(pdf.pages)
        except Exception:  # noqa: BLE001, S112
            continue
    return 0


#: Ways to look for tables, tried in turn until one finds a filled cell.
TABLE_WAYS = ({}, {"vertical_strategy": "lines", "horizontal_strategy": "lines", "intersection_tolerance": 5}, {"vertical_strategy": "text", "horizontal_strategy": "text"})


def plumbed_pages(content: bytes) -> list[tuple[str, list]]:
    """(text, tables) of every page; a table is rows of cells."""
    import pdfplumber

    def tables(page) -> list:
        found = []
        for way in TABLE_WAYS:
            try:
                found = page.extract_tables(way)
            except Exception:  # noqa: BLE001, S112
                continue
            if any(any(row) for table in found or [] for row in table):
                break
        return found or []

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [(p.extract_text() or "", tables(p)) for p in pdf.pages]


def fitz_pages(content: bytes) -> list[tuple[str, list]]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [(p.get_text() or "", []) for p in doc]


#: The text layers a page may be read by, in the order of ``pages.METHODS``.
LAYERS: dict[str, Callable[[bytes], list[tuple[str, list]]]] = {"pdfplumber": plumbed_pages, "pymupdf": fitz_pages}


def page_counts(files: DataFrame, count: Callable[[bytes], int] = pdf_page_count) -> DataFrame:
    """(doc_id, pages): the number of pages of every file, 0 for one that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [0 if x is None else count(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["doc_id", "pages"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, pages int")


def page_layers(files: DataFrame, layers: dict[str, Callable[[bytes], list[tuple[str, list]]]] | None = None) -> DataFrame:
    """(doc_id, page_number, method, text, confidence): every page by every text layer, the candidates of ``pages.resolve_pages``.

    Tables follow the text as Markdown and runs of numbers are set as tables
    (for layers that find tables); a layer that cannot read a file gives nothing for it.
    """
    layers = LAYERS if layers is None else layers
    tables = pa.list_(pa.list_(pa.list_(pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, read in layers.items():
                    try:
                        got = read(content) if content is not None else []
                    except Exception:  # noqa: BLE001
                        got = []
                    rows += [(doc, i, name, text, found) for i, (text, found) in enumerate(got, 1)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), tables)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "page_number", "method", "text", "tables"])

    rows = files.select("doc_id", "content").mapInArrow(run, "doc_id string, page_number int, method string, text string, tables array<array<array<string>>>")
    shown = T.markdown_tables(F.col("tables"))
    both = F.when((F.trim("text") != "") & (F.trim(shown) != ""), F.concat("text", F.lit("\n\n"), shown)).when(F.col("text") != "", F.col("text")).otherwise(shown)
    whole = rows.select("doc_id", "page_number", "method", both.alias("text"))
    set_out = layout.repair_tables(whole.filter(F.col("method") == "pdfplumber"), ["doc_id", "page_number", "method"])
    out = set_out.unionByName(whole.filter(F.col("method") != "pdfplumber"))
    return out.withColumn("confidence", F.coalesce(pages.layer_confidence(F.col("method"), F.col("text")), F.lit(0.0)))


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, file_name, content) of binary files; each file is a document, files of no bytes are not listed."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return df.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def decode_pages(files: DataFrame, decode: Callable[[bytes], list[str]] = pdf_pages, max_pages: int | None = None) -> DataFrame:
    """(doc_id, page_number, text): files decoded page by page, at most ``max_pages`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pages = decode(content)[:max_pages] if content is not None else []
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(pages), pa.string()), pa.array(range(1, len(pages) + 1), pa.int32()), pa.array(pages, pa.string())], names=["doc_id", "page_number", "text"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, page_number int, text string")


def load_text(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(doc_id, text) of txt, json or pdf files by their ending; any other is an error. JSON is set out with an indent of two."""
    kind = (kind or path.rsplit(".", 1)[-1]).lower()
    if kind in ("txt", "json"):
        df = spark.read.text(path, wholetext=True)
        text = F.coalesce(jsons.pretty_json("value"), F.col("value")) if kind == "json" else F.col("value")
        return df.select(F.col("_metadata.file_path").alias("doc_id"), text.alias("text"))
    if kind == "pdf":
        decoded = decode_pages(read_files(spark, path, "*"))
        listed = F.array_sort(F.collect_list(F.struct("page_number", "text")))
        return decoded.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "\n").alias("text"))
    raise ValueError(f"unsupported file type: {kind}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored extraction results, one row a file."""
    return spark.read.schema(RESULT).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("doc_id"), "*")


def result_blocks(results: DataFrame) -> DataFrame:
    """(doc_id, page_number, block_no, type, content) of stored results, blocks without content left out."""
    each = results.select("doc_id", F.posexplode("pages").alias("_p", "page"))
    number = F.coalesce("page.page_number", F.col("_p") + 1)
    return each.select("doc_id", number.alias("page_number"), F.posexplode("page.blocks").alias("block_no", "b")).select("doc_id", "page_number", "block_no", "b.type", "b.content").filter("content IS NOT NULL")


def recognised_items(results: DataFrame, json: str = "json") -> DataFrame:
    """(doc_id, page_number, pos, polygon, text) of recognition results: an object of one page list under any name."""
    by_name = F.from_json(F.col(json), f"map<string,{BOXES}>")
    each = results.select("doc_id", F.posexplode(F.element_at(F.map_values(by_name), 1)).alias("_p", "page"))
    return each.select("doc_id", (F.col("_p") + 1).alias("page_number"), F.posexplode("page.text_lines").alias("pos", "i")).select("doc_id", "page_number", "pos", "i.polygon", "i.text")
