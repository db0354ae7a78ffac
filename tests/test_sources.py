import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stratafin.sinks import artifacts as K
from stratafin.sources import documents as D
from stratafin.streaming import uploads as U

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def fake_decode(content):
    return content.decode().split("\f")


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("one\ftwo\fthree".encode())
    (tmp_path / "b.pdf").write_bytes(b" ")
    (tmp_path / "c.txt").write_text("x\ny")
    files = D.read_files(spark, str(tmp_path))
    assert sorted(r.file_name for r in files.collect()) == ["a.pdf", "b.pdf"]
    pages = D.decode_pages(files, fake_decode, max_pages=2).filter("trim(text) <> ''")
    assert [(r.page_number, r.text) for r in pages.orderBy("page_number").collect()] == [(1, "one"), (2, "two")]
    assert D.load_text(spark, str(tmp_path / "c.txt")).first().text == "x\ny"
    with pytest.raises(ValueError):
        D.load_text(spark, "x.docx")


def test_layers_and_counts(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.json").write_text('{"k":[1]}')

    def plumbed(content):
        if content == b"bad":
            raise ValueError
        return [("text", [[["a", "b"], ["1", None]], [[None]]]), ("", [])]

    files = D.read_files(spark, str(tmp_path))
    rows = D.page_layers(files, {"pdfplumber": plumbed, "pymupdf": lambda c: [(c.decode(), [])]})
    got = {(r.doc_id[-5:], r.page_number, r.method): (r.text, r.confidence) for r in rows.collect()}
    assert got["a.pdf", 1, "pdfplumber"] == ("text\n\n\n### TABLE 1\n\n| a | b |\n| --- | --- |\n| 1 | |", 0.9) and got["a.pdf", 2, "pdfplumber"] == ("", 0.1)
    assert got["b.pdf", 1, "pymupdf"] == ("bad", 0.75) and len(got) == 4
    assert {r.doc_id[-5:]: r.pages for r in D.page_counts(files, len).collect()} == {"a.pdf": 3, "b.pdf": 3}
    assert {r.pages for r in D.page_counts(files).collect()} == {0}  # no decoder can read them
    assert D.load_text(spark, str(tmp_path / "c.json")).first().text == '{\n  "k": [\n    1\n  ]\n}'


def test_results(spark, tmp_path):
    result = {"metadata": {"parsers_used": ["surya"]}, "stats": {"total_pages": 1}, "pages": [{"page_number": 1, "blocks": [{"type": "text", "content": "a", "y": 1.0}, {"content": None}]}, {"page_number": 2, "error": "x"}]}
    (tmp_path / "r.json").write_text(json.dumps(result, indent=2))
    df = D.read_results(spark, str(tmp_path / "r.json"))
    assert [(r.page_number, r.block_no, r.content) for r in D.result_blocks(df).collect()] == [(1, 0, "a")]
    boxes = spark.createDataFrame([("D", '{"f": [{"text_lines": [{"text": "t", "polygon": [[1, 2]]}]}]}')], "doc_id string, json string")
    assert [(r.page_number, r.pos, r.text, r.polygon) for r in D.recognised_items(boxes).collect()] == [(1, 0, "t", [[1.0, 2.0]])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "x\ny"), ("B", None)], "doc_id string, text string")
    K.write_texts(df.filter("text IS NOT NULL"), str(tmp_path / "t"), folders=True)
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    K.write_texts(df, str(tmp_path / "k"))
    assert {(r.doc_id, r.text) for r in spark.read.json(str(tmp_path / "k")).collect()} == {("A", "x\ny"), ("B", None)}
    K.write_json(df, str(tmp_path / "j"))
    assert sorted(json.loads(r.value)["doc_id"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ["A", "B"]
    assert K.artifact_name("f", "s") == "extracted_f_all_s" and K.artifact_name("f", "s", 10) == "extracted_f_first10_s"
    rows = spark.createDataFrame([("A", 2, 0, ["b"]), ("A", 1, 0, ["a"]), ("B", 1, 0, ["c"])], "doc_id string, section int, ord int, cells array<string>")
    out = str(tmp_path)

    def write(doc, got):
        with open(f"{out}/{doc}.rep", "w") as f:
            f.write(" ".join(c for r in got for c in r.cells))

    K.write_reports(rows, write)
    assert (tmp_path / "A.rep").read_text() == "a b" and (tmp_path / "B.rep").read_text() == "c"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / "in" / f"{n}.pdf").write_bytes(n.encode())
    stream = U.uploaded_files(spark, str(tmp_path / "in"), per_batch=1)
    q = U.analyze_uploads(stream, lambda df: df.select("file_name", F.length("content").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r.file_name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.pdf", "b.pdf"]
