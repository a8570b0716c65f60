"""Parsing, chunking, routing, storing, syncing and answering on tiny files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.operators import chunking, pdf, prep, profile
from tesserae.operators.sync import ChunkStore, fingerprint, fingerprints
from tesserae.operators.table_query import TableRequest
from tesserae.plans.answering import Answering, Generated, QueryLog, Topic, history_text, rewrite_question, route_question, with_retries
from tesserae.plans.ingest import ingest_topic
from tesserae.sources.files import route, topic_files, topics
from tesserae.sources.html import clean_text, docx_blocks, html_blocks, markdown_blocks, parse_text, sections
from tesserae.sources.tables import TableStore, load_tables, tidy
from tesserae.streaming.ingest import stream_records


def test_markdown_sections():
    text = "# Report\nintro\n\n## Risk\nhigh\n### Detail\nmore\n## Fix\nact"
    assert sections(markdown_blocks(text)) == [("Report", "intro"), ("Report > Risk", "high"), ("Report > Risk > Detail", "more"), ("Report > Fix", "act")]
    assert sections(markdown_blocks("# A\n```\n# no heading\n```\n## B\n## C\n---\n## D\nx")) == [("A", "```\n# no heading\n```"), ("A > D", "x")]


def test_html_sections():
    html = "<html><head><style>p{}</style></head><body><script>no()</script><h1>Guide</h1><p>Hello</p><div>lost</div><h2>Price</h2><p>Now</p><table><tr><td>A</td><td>B</td></tr><tr><td>1</td><td>2</td></tr></table></body></html>"
    got = sections(html_blocks(html))
    assert got == [("Guide", "Hello"), ("Guide > Price", "Now\n\nA | B\n\n1 | 2")] and "no()" not in str(got)
    assert html_blocks("<body><p>a<p>b</p></p></body>") == [("para", 0, "b")]


def docx(path, parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in parts)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")


def test_docx(tmp_path):
    docx(tmp_path / "a.docx", [("Title", "Doc"), ("Heading1", "One"), ("Normal", "body")])
    assert docx_blocks((tmp_path / "a.docx").read_bytes()) == [("heading", 1, "Doc"), ("heading", 2, "One"), ("para", 0, "body"), ("para", 0, "x | y")]
    assert parse_text("ï".encode("cp1252"), ".log") == [("", "ï")] and clean_text("a\r\n\r\n\r\n b") == "a\n\nb"


def test_splitting():
    text = " ".join(f"Sentence number {i} says something of its own." for i in range(120))
    got = chunking.split_record(text, "text", None)
    assert len(got) > 3 and all(len(p) <= 1000 for p in got) and all(any(s in b for s in a[-190:].split(". ") if len(s) > 20) for a, b in zip(got, got[1:]))
    headed = chunking.split_record(text, "text", "Report > Risk")
    assert all(p.startswith("Report > Risk\n\n") and len(p) <= 1000 for p in headed)
    lines = [f"{i} | value {i}" for i in range(400)]
    table = chunking.split_record("\n".join(["row | v", *lines]), "table", None)
    assert all(p.startswith("row | v\n") and len(p) <= 3000 for p in table) and [x for p in table for x in p.split("\n")[1:]] == lines
    assert chunking.split_record("---", "text", None) == [] and all(len(p) <= 1000 for p in chunking.split_record("x" * 5000, "text", None))


def records(spark, *rows):
    return spark.createDataFrame([("t", s, o, t, "text", None, None, None, None, h) for s, o, t, h in rows], chunking.RECORD)


def test_chunks(spark):
    r = records(spark, ("a.md", 0, "one", "H"), ("a.md", 1, "two", None), ("b.md", 0, "three", None), ("b.md", 1, " ", None))
    got = {c["id"]: c for c in chunking.chunk_records(r).collect()}
    assert set(got) == {"t/a.md/s0/0", "t/a.md/s1/0", "t/b.md/s0/0"} and got["t/a.md/s0/0"]["text"] == "H\n\none"
    again = {c["id"]: c["content_hash"] for c in chunking.chunk_records(r).collect()}
    assert again == {k: c["content_hash"] for k, c in got.items()} and len({c["content_hash"] for c in got.values()}) == 3
    place = spark.range(1).select(chunking.location(F.lit(3), F.lit("p3t1"), F.lit("summary"), F.lit("x\\y/fig.one.png"), F.lit(0)).alias("x")).first()["x"]
    assert place == "p3-tp3t1-summary-ifig.one"
    label = lambda m, *a: spark.range(1).select(chunking.make_label(F.lit(m), F.lit("x.csv"), *(F.lit(v) for v in a)).alias("x")).first()["x"]
    assert label("table", None, "main", "rows-1-9", None) == "table x.csv rows 1-9" and label("text", 3, None, None, None) == "text p.3" and label("image", 2, None, None, "a/f.png") == "image f.png p.2"


def test_sync(spark, tmp_path):
    calls = []

    def embed(texts):
        (tmp_path / "calls").open("a").write(f"{len(texts)}\n")
        return [[1.0, 0.0] for _ in texts]

    store = ChunkStore(spark, str(tmp_path / "store"), embed)
    chunks = lambda *rows: chunking.chunk_records(records(spark, *rows))
    base = [("a.md", 0, "one", None), ("b.md", 0, "two", None)]
    s = store.sync("t", chunks(*base))
    assert (s.added, s.unchanged) == (2, 0) and store.topics() == ["t"] and store.count("t") == 2
    mark, before = fingerprint(store.chunks("t")), (tmp_path / "calls").read_text()
    s = store.sync("t", chunks(*base))
    assert (s.added, s.unchanged) == (0, 2) and (tmp_path / "calls").read_text() == before and fingerprint(store.chunks("t")) == mark
    s = store.sync("t", chunks(("a.md", 0, "one changed", None), ("c.md", 0, "new", None)), protected_sources=["b.md"])
    assert (s.added, s.updated, s.deleted, s.protected) == (1, 1, 0, 1) and store.count("t") == 3 and fingerprint(store.chunks("t")) != mark
    s = store.sync("t", chunks(("a.md", 0, "one changed", None)))
    assert (s.unchanged, s.deleted) == (1, 2) and store.count("t") == 1
    assert fingerprints(store.chunks("t"), "topic_id").first()["fingerprint"] == fingerprint(store.chunks("t"))
    with pytest.raises(ValueError, match="refusing"):
        store.sync("t", chunks())
    with pytest.raises(ValueError, match="another topic"):
        store.sync("other", chunks(*base))
    with pytest.raises(ValueError, match="share the id"):
        store.sync("t", chunks(("a.md", 0, "x", None), ("a.md", 0, "y", None)))
    assert store.sync("t", chunks(), allow_empty=True).deleted == 1
    store.delete_topic("t")
    assert store.topics() == [] and not calls


@pytest.fixture
def folder(tmp_path):
    t = tmp_path / "data" / "shop"
    (t / "sub").mkdir(parents=True)
    (tmp_path / "data" / "Bad Name").mkdir()
    (tmp_path / "data" / "Bad Name" / "x.md").write_text("x")
    (t / "topic.json").write_text("﻿" + json.dumps({"name": "The Shop"}))
    (t / "a.md").write_text("# Head\nSome text about snakes.")
    (t / "b.csv").write_text("name;city;units\nann;Köln;1\nbob;Bonn;2\neve;;3\n", encoding="latin-1")
    (t / "sub" / "c.log").write_text("a log line")
    (t / "pdf.csv").write_bytes(b"%PDF-1.4")
    (t / "img.txt").write_bytes(b"\xff\xd8\xff\xe0")
    (t / "empty.md").write_text("")
    (t / "fake.pdf").write_text("no pdf")
    (t / "x.exe").write_text("x")
    (t / "old.csv").write_bytes(b"\xd0\xcf\x11\xe0aaaa")
    (t / "bin.txt").write_bytes(b"ab\x00cd")
    (t / "broken.json").write_text("{")
    (t / "list.json").write_text('{"n": 1, "restaurants": [{"restaurant": {"name": "A", "rating": {"x": 4.5}, "tags": ["t"]}}, {"restaurant": {"name": "B", "rating": {"x": 3}, "tags": []}}]}')
    (t / "plain.json").write_text('{"a": 1}')
    (t / "~$lock.md").write_text("x")
    (t / "README.md").write_text("x")
    return tmp_path / "data"


def test_routing(spark, folder):
    files = topic_files(spark, str(folder))
    got = {r["source"]: (r["kind"], r["skip_reason"]) for r in route(files).collect()}
    kinds = {"a.md": "text", "b.csv": "table", "sub/c.log": "text", "pdf.csv": "pdf", "img.txt": "image", "list.json": "table", "plain.json": "text"}
    assert {k: v[0] for k, v in got.items() if v[0]} == kinds
    assert {k for k, v in got.items() if v[1]} == {"empty.md", "fake.pdf", "x.exe", "old.csv", "bin.txt", "broken.json"}
    assert [tuple(r) for r in topics(files).collect()] == [("shop", "The Shop", "Documents about The Shop")]


def test_tables(spark, folder, tmp_path):
    csv = load_tables(spark, str(folder / "shop" / "b.csv"))["main"]
    assert csv.columns == ["name", "city", "units"] and [tuple(r) for r in csv.collect()] == [("ann", "Köln", 1), ("bob", "Bonn", 2), ("eve", None, 3)]
    rows = load_tables(spark, str(folder / "shop" / "list.json"))["main"]
    assert rows.columns == ["name", "rating.x", "tags"] and rows.collect()[0]["rating.x"] == 4.5
    odd = spark.createDataFrame([(0, "a", None, [1]), (1, "b", None, [2]), (2, None, None, None)], "`Unnamed: 0` int, a string, gone string, n array<int>")
    assert tidy(odd).columns == ["a", "n"] and tidy(odd).count() == 3
    store = TableStore(spark, str(tmp_path / "tables"))
    store.save(csv, "shop", "b.csv")
    store.save(rows, "shop", "list.json")
    catalog = store.catalog(["shop"])
    assert [(t.ref, t.source, t.rows) for t in catalog] == [("T1", "b.csv", 3), ("T2", "list.json", 2)] and catalog[0].columns["units"] == "integer"
    assert store.prune("shop", {("b.csv", "main")}) == [("list.json", "main")] and len(store.catalog(["shop"])) == 1
    with pytest.raises(FileNotFoundError):
        store.load("shop", "list.json")


def xlsx(path, sheets):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="{r}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {m}><sheetData>" + "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows) + "</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    xlsx(tmp_path / "b.xlsx", {"Sales 2024": [["a", "b"], ["x", 1], ["y", 2.5]], "Small": [["q"], [7]], "Empty": []})
    got = load_tables(spark, str(tmp_path / "b.xlsx"))
    assert set(got) == {"Sales_2024", "Small"} and [tuple(r) for r in got["Sales_2024"].collect()] == [("x", 1.0), ("y", 2.5)]


def test_profile(spark):
    sales = spark.createDataFrame([(i - 1, ("North", "South", "North", "East")[(i - 1) % 4], i, (2.5, 3.0, 4.5, 1.25)[(i - 1) % 4]) for i in range(1, 21)], "_row long, region string, units int, price double")
    lines = {c: profile.column_line(c, p) for c, p in profile.profile(sales, row="_row").items()}
    assert lines["units"] == "- units (integer): min 1, max 20, mean 10.5, median 10.5" and lines["region"] == "- region (text): values: North (10), South (5), East (5)"
    got = profile.table_records(sales, "t", "s.csv").orderBy("ordinal").collect()
    assert got[0]["part"] == "summary" and "20 rows x 3 columns" in got[0]["text"] and got[1]["part"].startswith("rows-1-") and "row | region | units | price" in got[1]["text"]
    body = [x for r in got[1:] for x in r["text"].split("\n")[2:]]
    assert body[0] == "1 | North | 1 | 2.5" and [int(x.split(" | ")[0]) for x in body] == list(range(1, 21))
    big = spark.range(1000).select(F.col("id").alias("_row"), (F.col("id") % 7).alias("v"))
    parts = [r["part"] for r in profile.table_records(big, "t", "b.csv").collect()]
    assert any(p.startswith("sample-") for p in parts)
    odd = spark.createDataFrame([(1, "a|b\nc", "x" * 500)], "_row long, a string, b string")
    line = profile.render_rows(odd).first()["line"]
    assert line.startswith("1 | a/b c | xxx") and line.endswith("…")


def test_preparing(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else "d") for i in range(32)], "id int, g string")
    assert {r["g"] for r in prep.in_top(df, "g", 3).collect()} == {"a", "b", "c"}
    a, b = (sorted(r["id"] for r in prep.stratified(df, "g", "id", 2, 42).collect()) for _ in range(2))
    assert a == b and len(a) == 8 and prep.complement(df, df.where("id < 10"), "id").count() == 22
    got = prep.bounded_groups(df, ["g"], "id", 8, 2, 3).collect()
    assert len(got) == 6 and {r["g"] for r in got} == {"a", "b"}


def test_pdf_pages(spark):
    b = spark.createDataFrame([("d", p, s, float(s * 10), 0.0, float(s * 10 + 10), 10.0, t) for p, s, t in [(1, 0, "Journal 1"), (1, 1, "intro text " * 9), (2, 0, "Journal 2"), (2, 1, "more body " * 9), (3, 0, "Journal 3"), (3, 1, "References"), (3, 2, "[1] a paper"), (4, 0, "Journal 4"), (4, 1, "[2] another"), (4, 2, "Appendix A"), (4, 3, "kept")]], "doc string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string")
    clean = pdf.without_running_heads(b)
    assert clean.count() == 7 and [r["text"] for r in pdf.without_references(clean).orderBy("page", "seq").collect()][2:] == ["Appendix A", "kept"]
    areas = spark.createDataFrame([(1, 8.0, 0.0, 25.0, 10.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert pdf.outside_tables(b.where("page = 1"), areas).count() == 1
    f = [("d", p, 0, "logo", 200, 200, 0.1) for p in range(1, 5)] + [("d", 1, 1, "a", 300, 200, 0.2), ("d", 2, 1, "a", 300, 200, 0.2), ("d", 2, 2, "icon", 10, 10, 0.0), ("d", 3, 1, "b", 100, 100, 0.1), ("d", 3, 2, "back", 900, 900, 1.0)]
    figures = spark.createDataFrame(f, "doc string, page int, seq int, digest string, width int, height int, cover double")
    assert [(r["page"], r["digest"], r["number"]) for r in pdf.select_figures(figures).orderBy("page").collect()] == [(1, "a", 1), (3, "b", 1)]
    assert [r["digest"] for r in pdf.select_figures(figures, most=1).collect()] == ["a"]


def test_from_files_to_answers(spark, folder, tmp_path):
    for name in ("pdf.csv", "img.txt"):
        (folder / "shop" / name).unlink()
    chunks, tables = ChunkStore(spark, str(tmp_path / "c")), TableStore(spark, str(tmp_path / "t"))
    report = ingest_topic(spark, str(folder), "shop", chunks, tables)
    assert not report.failed and len(report.skipped) == 6 and report.stats.added == chunks.count("shop") > 4
    assert ingest_topic(spark, str(folder), "shop", chunks, tables).stats.unchanged == report.stats.added
    prompts = []

    def generator(prompt):
        prompts.append(prompt)
        if "Calculations:" not in prompt:
            return Generated("", requests=[TableRequest("b.csv", "sum", "units")])
        return Generated("There are 6 units [C1], see [1] and [99].", True, [1], [1])

    log = tmp_path / "log" / "q.jsonl"
    rag = Answering(spark, [Topic("shop", "Shop")], chunks, tables, generator=generator, log=QueryLog(str(log)))
    got = rag.answer("how many units and snakes?")
    assert got.status == "answered" and got.text == "There are 6 units [C1], see [1] and." and got.calculations[0].value == 6 and len(prompts) == 2
    assert [s["name"] for s in got.trace.steps] == ["rewrite", "route", "embed", "search", "merge", "context", "generate"] and json.loads(log.read_text())["status"] == "answered"
    assert "calculation: sum(units)" in got.citations.sources[-1].display
    assert rag.answer("x" * 2001).status == "input" and rag.answer(" ").status == "input"
    rag.router = lambda prompt: []
    assert rag.answer("anything").status == "router"
    broken = Answering(spark, [Topic("a", "A"), Topic("b", "B")], chunks, search=lambda t, q, v: 1 / 0 if t == "a" else [])
    assert broken.answer("q").status == "retrieval" and [("error" in s) for s in broken.answer("q").trace.steps if s["name"] == "search"] == [True, False]
    broken.search = lambda t, q, v: 1 / 0
    assert broken.answer("q").status == "error"


def test_questions():
    assert rewrite_question("q", [], lambda q, h: "no")[0] == "q" and rewrite_question("q", [{"role": "user", "content": "x"}], lambda q, h: "new") == ("new", True)
    assert rewrite_question("q", [{"role": "user", "content": "x"}], lambda q, h: "y" * 601) == ("q", False)
    assert rewrite_question("q", [{"role": "user", "content": "x"}], lambda q, h: 1 / 0) == ("q", False)
    assert history_text([{"role": "system", "content": "a \n b"}, {"role": "user", "content": "z" * 700}]) == "Assistant: a b\nUser: " + "z" * 600 + "…"
    known = [Topic(x, x) for x in "abcd"]
    assert route_question("q", known, lambda p: ["b", "x", "b", "a", "c", "d"]).topics == ["b", "a", "c"] and route_question("q", known, lambda p: ["x"]).fallback
    assert route_question("q", known, lambda p: []).topics == [] and route_question("q", known, lambda p: 1 / 0).topics == list("abcd")
    waits, left = [], [ConnectionError(), ConnectionError()]
    assert with_retries(lambda: 5 if not left else (_ for _ in ()).throw(left.pop()), sleep=waits.append) == 5 and waits == [2.0, 4.0]
    with pytest.raises(KeyError):
        with_retries(lambda: {}["x"], sleep=waits.append)


def test_stream(spark, tmp_path):
    schema = "source string, text string"
    src = tmp_path / "in"
    spark.createDataFrame([("a", "one")], schema).coalesce(1).write.parquet(str(src))
    store = ChunkStore(spark, str(tmp_path / "s"))

    def rec(df):
        none = lambda t="string": F.lit(None).cast(t)
        return df.select(F.lit("t").alias("topic_id"), "source", F.lit(0).alias("ordinal"), "text", F.lit("text").alias("modality"), none("int").alias("page"), none().alias("table_id"), none().alias("part"), none().alias("image_path"), none().alias("heading"))

    go = lambda: stream_records(spark, str(src), schema, store, str(tmp_path / "cp"), "t", rec).awaitTermination(120)
    go()
    assert store.count("t") == 1
    spark.createDataFrame([("b", "two"), ("a", "one changed")], schema).coalesce(1).write.mode("append").parquet(str(src))
    go()
    assert {r["text"] for r in store.chunks("t").collect()} == {"one changed", "two"}
