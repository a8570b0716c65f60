"""Evaluation of a whole run, routing cases and the picture cache."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import vision
from tesserae.operators.sync import ChunkStore
from tesserae.plans.answering import Answering, Generated, Topic
from tesserae.plans.evaluate import check_routing, report, run_questions, scored


def test_run(spark, tmp_path):
    hit = {"id": "t/a.md/s0/0", "text": "there are 2451 places", "score": 1.0, "distance": 0.1, "bm25_rank": 1, "source": "a.md", "page": None, "label": "text"}
    rag = Answering(spark, [Topic("t", "T")], ChunkStore(spark, str(tmp_path)), search=lambda t, q, v: [] if "nothing" in q else [hit], generator=lambda p: Generated("There are 2,451 places [1]."))
    questions = [
        {"id": "a", "category": "x", "question": "how many?", "expected_numbers": [{"value": 2451}], "must_contain": ["places"], "expected_topics": ["t"], "relevant": [{"topic": "t", "source": "a.md"}]},
        {"id": "b", "category": "x", "question": "how many again?", "expected_numbers": [{"value": 7, "tol": 1}]},
        {"id": "c", "category": "y", "question": "nothing here", "should_refuse": True},
    ]
    rows = scored(spark, *run_questions(rag, questions, judge=lambda q, a, c: {"claims": ["supported", "not"], "facts": ["present"], "relevance": "partial"}))
    got = report(rows, {"model": "none"})
    assert got["summary"]["questions"] == 3 and got["summary"]["numbers_ok"] == 0.5 and got["summary"]["recall"] == 1 and got["summary"]["answer_relevance"] == 0.5
    assert got["by_category"]["y"]["refusal_ok"] == 1 and set(got["failures"]) == {"a", "b"} and "numbers_ok" in got["failures"]["b"]
    assert check_routing([Topic("a", "A"), Topic("b", "B")], lambda p: ["a"], [{"question": "q", "expected": ["a"]}, {"question": "q", "expected": ["b"]}])[0] == 0.5


def test_pictures(spark, tmp_path):
    log = tmp_path / "calls"

    def analyzer(content, mime):
        log.open("a").write("x")
        return {"caption": f"{len(content)} bytes", "ocr_text": " ", "details": "d"}

    images = spark.createDataFrame([("t", "a.png", "image/png", b"abc"), ("t", "copy.png", "image/png", b"abc"), ("t", "b.png", "image/png", b"abcd")], "topic_id string, source string, mime string, content binary").withColumn("sha1", F.sha1("content"))
    cache = str(tmp_path / "cache")
    got = vision.image_records(vision.analyze(images, cache, analyzer, "m", "1")).collect()
    assert {r["source"]: r["text"] for r in got} == {"a.png": "Caption: 3 bytes\n\nDetails: d", "copy.png": "Caption: 3 bytes\n\nDetails: d", "b.png": "Caption: 4 bytes\n\nDetails: d"}
    assert log.read_text() == "xx"
    vision.analyze(images, cache, analyzer, "m", "1").count()
    assert log.read_text() == "xx"
    vision.analyze(images, cache, analyzer, "m", "2").count()
    assert log.read_text() == "xxxx"
    with pytest.raises(Exception):  # noqa: B017
        vision.analyze(images.withColumn("sha1", F.lit("new")), cache, lambda c, m: 1 / 0, "m", "3").count()
