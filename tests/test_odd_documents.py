"""Queries over folders of files beside their SQL on documents without text, documents of one doc_id, and letters that XML has marks for."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folio.plans import catalog
from folio.sources import annotations


def differences(spark, name, folder):
    got = catalog.queries()[name](spark, folder).toArrow()
    con = duckdb.connect()
    con.register("got", got)
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    con.execute(f"create table want as {catalog.oracle_sql()[name]}")
    columns = ", ".join(r[0] for r in con.sql("describe want").fetchall())
    return [con.sql(f"select {columns} from {x} except all select {columns} from {y}").fetchall() for x, y in (("got", "want"), ("want", "got"))]


def documents(folder, rows):
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string()}
    pq.write_table(pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), zip(*rows, strict=True), strict=True)}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["read_ground_truth", "scan_files", "stream_ground_truth"])
def test_documents_without_text(spark, tmp_path, name):
    assert differences(spark, name, documents(tmp_path, [(i, "" if i % 3 else f"line {i}\n", "en", "src") for i in range(48)])) == [[], []]


@pytest.mark.parametrize("name", ["read_ground_truth", "scan_files", "stream_ground_truth"])
def test_documents_of_one_id(spark, tmp_path, name):
    """Three documents of an id, two of them the same row."""
    rows = [(i, f"{i}", "en", "src") for i in range(16)]
    assert differences(spark, name, documents(tmp_path, rows + rows + [(i, f"other {i}", "fr", "src2") for i in range(16)])) == [[], []]


def test_marks_and_spaces_in_xml(spark, tmp_path):
    rows = [(i, "t", "a & b", [" <src> ", "]]>", "&amp;", "\tx "][i // 8]) for i in range(32)]
    assert differences(spark, "read_ground_truth", documents(tmp_path, rows)) == [[], []]


def test_empty_files_are_judged(spark, tmp_path):
    for name in ("a.json", "b.xml", "c.txt"):
        (tmp_path / name).write_text("")
    (tmp_path / "d.XML").write_text(" \n")
    truth = {r["path"].rpartition("/")[2]: r["reason"] for r in annotations.judged_ground_truth(spark, str(tmp_path)).collect()}
    assert truth == {"a.json": "unreadable", "b.xml": "unreadable", "c.txt": "not an annotation", "d.XML": "unreadable"}
