"""PDF files and pictures through ingestion, with backends that are functions, and the command line's chat and check."""

import json

import pytest

from tesserae import __main__ as command
from tesserae.operators.sync import ChunkStore
from tesserae.operators.vision import image_reader
from tesserae.plans.answering import Answer
from tesserae.plans.ingest import ingest_topic
from tesserae.plans.pdf import pdf_reader
from tesserae.sources.tables import TableStore

BOX = {"x0": 0.0, "x1": 100.0}


def backend(content):
    """Four pages: a running head on each, text, a table with a block inside, a scan, references, a figure and a logo."""
    assert content.startswith(b"%PDF")
    head = [{"page": p, "seq": 0, "y0": 0.0, "y1": 5.0, "text": f"Report page {p}", **BOX} for p in range(1, 5)]
    text = [
        {"page": 1, "seq": 1, "y0": 10.0, "y1": 20.0, "text": "The infor-\nmation [3] of the first page is long enough to stand before all references.", **BOX},
        {"page": 1, "seq": 2, "y0": 30.0, "y1": 40.0, "text": "inside the table", **BOX},
        {"page": 2, "seq": 1, "y0": 10.0, "y1": 20.0, "text": "The second page says more about the matter at hand.", **BOX},
        {"page": 2, "seq": 2, "y0": 30.0, "y1": 40.0, "text": "References", **BOX}, {"page": 2, "seq": 3, "y0": 50.0, "y1": 60.0, "text": "[1] Someone", **BOX},
    ]
    cells = [["0-City", "1-City", "n"], ["Lyon", "Rhône", "1,200"], ["Paris", None, "2,400"]]
    figures = [{"page": p, "seq": 9, "digest": "logo", "width": 100, "height": 100, "cover": 0.1, "content": "00"} for p in (1, 2, 3)]
    figures.append({"page": 2, "seq": 5, "digest": "chart", "width": 300, "height": 200, "cover": 0.2, "content": "89504e47"})
    return {"pages": [{"page": p, "images": int(p == 3)} for p in range(1, 5)], "blocks": head + text, "tables": [{"page": 1, "y0": 28.0, "y1": 45.0, "cells": cells, **BOX}], "figures": figures}


@pytest.fixture
def data(tmp_path):
    folder = tmp_path / "data" / "reports"
    folder.mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"%PDF-1.4 made up")
    (folder / "b.png").write_bytes(bytes.fromhex("89504e470d0a1a0a") + b"picture")
    return str(tmp_path / "data")


def test_pdf_and_pictures_are_ingested(spark, data, tmp_path):
    calls = []
    chunks, tables = ChunkStore(spark, str(tmp_path / "chunks")), TableStore(spark, str(tmp_path / "tables"))
    analyzer = lambda content, mime: {"caption": f"a chart, {mime}", "ocr_text": "", "details": None}
    readers = {
        "pdf": pdf_reader(backend, tables, ocr=lambda content, page: f"scanned words of page {page}", analyzer=analyzer),
        "image": image_reader(str(tmp_path / "cache"), analyzer, "m", "1", prepare=lambda c: (c, "image/jpeg")),
    }
    report = ingest_topic(spark, data, "reports", chunks, tables, readers)
    assert not report.failed and not calls
    rows = {(r["source"], r["modality"], r["page"], r["table_id"], r["part"]): r["text"] for r in chunks.chunks("reports").collect()}
    text = {k[2]: v for k, v in rows.items() if k[:2] == ("a.pdf", "text")}
    assert text[1] == "The information of the first page is long enough to stand before all references." and text[2] == "The second page says more about the matter at hand."
    assert text[3] == "scanned words of page 3"
    assert any(k[3] == "p1t1" and k[4] == "summary" and "City_2" in v for k, v in rows.items())
    assert [tuple(r) for r in tables.load("reports", "a.pdf", "p1t1").orderBy("n").collect()] == [("Lyon", "Rhône", 1200.0), ("Paris", None, 2400.0)]
    assert rows["a.pdf", "image", 2, None, None] == "Caption: a chart, image/png" and rows["b.png", "image", None, None, None] == "Caption: a chart, image/jpeg"
    again = ingest_topic(spark, data, "reports", chunks, tables, readers)
    assert (again.stats.added, again.stats.updated, again.stats.deleted) == (0, 0, 0) and again.stats.unchanged == len(rows)


def test_a_broken_file_is_reported(spark, data, tmp_path):
    chunks, tables = ChunkStore(spark, str(tmp_path / "chunks")), TableStore(spark, str(tmp_path / "tables"))

    def broken(content):
        raise ValueError("locked by a password")

    report = ingest_topic(spark, data, "reports", chunks, tables, {"pdf": pdf_reader(broken, tables)})
    assert "locked by a password" in report.failed["a.pdf"] and "no backend" in report.failed["b.png"]


def test_chat_keeps_what_was_said():
    asked, said = [], []

    class Fake:
        def answer(self, question, history):
            asked.append((question, json.dumps(history)))
            return Answer("answered", f"about {question}", question)

    command.chat(Fake(), ["one\n", " two \n", "\n", "three\n"], said.append)
    assert [q for q, _ in asked] == ["one", "two"] and said == ["about one", "about two"] and "about one" in asked[1][1]


def test_environment(spark, data, tmp_path):
    found = command.environment(spark, data, str(tmp_path / "store"))
    assert list(found) == ["spark", "arrow", "embedder", "topics", "store"] and not any(isinstance(x, Exception) for x in found.values())
    assert isinstance(command.environment(spark, str(tmp_path / "nothing"))["topics"], Exception)
