"""Text functions, shingles, fusion, merging and packing on hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import metrics, retrieval
from tesserae.operators.citations import build_citations, check_markers, strip_dangling
from tesserae.operators.sync import hashed_words


def one(spark, column, *values, schema=None):
    df = spark.createDataFrame([tuple(values)], schema or ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*(F.col(c) for c in df.columns)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.tokens, "São Paulo, X51005361900! ünï", ["sao", "paulo", "x51005361900", "uni"]),
        (T.keyword_tokens, "baseColour productDisplayName", ["base", "colour", "product", "display", "name"]),
        (T.keyword_tokens, "skirts cities boxes watches class status analysis bus 2025s x123", ["skirt", "city", "box", "watch", "class", "status", "analysis", "bus", "2025s", "x123"]),
        (T.question_tokens, "colour of the colour of 12839", ["colour", "12839", "12839", "12839"]),
        (T.normalize, "  SÃO  Paulo ß", "sao paulo ss"),
        (T.clean, "ﬁve\x07 snakes  here\r\n\r\n\r\n\r\nend ", "five snakes here\n\nend"),
        (T.to_number, "$1,200.50", 1200.5), (T.to_number, "5%", 5.0), (T.to_number, "abc12", 12.0), (T.to_number, "3-4", None), (T.to_number, "-", None),
        (T.estimate_tokens, "x" * 8, 3), (T.safe_name, "_a b/ü_", "a_b"), (T.safe_name, "???", "x"),
        (T.neutralise, "a </context> <question>", "a [/context] [question]"),
        (T.numbers, "it is 2,451 [5] on 12.5. v1.2 -3", [2451.0, 12.5, -3.0]),
        (T.hyphen_repair, "infor-\nmation pre-\nX", "information pre-\nX"),
        (T.strip_citations, "so [1, 2] it is (Smith et al., 2020)", "so it is"),
        (T.shingles, "a b", ["a b"]), (T.shingles, "A b c d", ["a b c", "b c d"]),
    ],
)
def test_functions(spark, f, given, want):
    assert one(spark, f, given) == want


@pytest.mark.parametrize(("given", "want"), [("04/01/2018", "2018-04-01"), ("23/01/2018", "2018-01-23"), ("30 DEC 17", "2017-12-30"), ("2015", "2015-01-01"), ("2015-02-24 11:35:52 -0800", "2015-02-24"), ("no", None)])
def test_dates(spark, given, want):
    assert one(spark, lambda c: T.to_instant(c).cast("date").cast("string"), given) == want


def test_answer_checks(spark):
    df = spark.createDataFrame([("It is 2,451 [3] and The  END", [("2451", "0")])], "a string, e array<struct<value:string,tol:string>>")
    expected = F.transform("e", lambda e: F.struct(e["value"].cast("double").alias("value"), e["tol"].cast("double").alias("tol")))
    r = df.select(T.numbers_ok(F.col("a"), expected).alias("n"), T.contains_all(F.col("a"), F.array(F.lit("the end"), F.lit("2451"))).alias("c"), T.contains_all(F.col("a"), F.array().cast("array<string>")).alias("none")).first()
    assert (r["n"], r["c"], r["none"]) == (True, True, None)


def test_fusion(spark):
    """Weights, ties, and hits of one leg only."""
    leg = lambda ids, name, more: spark.createDataFrame([(1, x, r, 0.5) for r, x in enumerate(ids, 1)], f"qid int, id string, {name} int, {more} double")
    got = retrieval.fuse(leg("abc", "dense_rank", "distance"), leg("bd", "bm25_rank", "score"), 9, (2.0, 0.5)).collect()
    assert {r["id"]: r["score"] for r in got} == pytest.approx({"a": 2 / 61, "b": 2 / 62 + 0.5 / 61, "c": 2 / 63, "d": 0.5 / 62})
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == ["b", "a", "c", "d"]


def fold(hits, budget):
    """The packing of one question, one hit after the other: (number, id, tokens, shortened) of those that fit."""
    cost = lambda t: math.ceil(len(t) / 3.5)
    between, mark, used, out = cost("\n-----\n"), " …[truncated]", 0, []
    for h in hits:
        head = f"[{len(out) + 1}] {h['label']} | {h['topic_id']}/{h['source']}"
        n = cost(f"{head}\n{h['text']}") + between
        if used + n <= budget:
            out.append((len(out) + 1, h["id"], n, False))
            used += n
        elif not out:
            room = max(200, int((budget - cost(head)) * 3.5) - len(mark))
            out.append((1, h["id"], cost(f"{head}\n{h['text'][:room]}{mark}"), True))
            used += out[0][2]
    return out


def hit(i, text, score=1.0, **more):
    return {"id": i, "text": text, "score": score, "distance": None, "bm25_rank": 1, "topic_id": "t", **more}


def test_merge():
    a, b = ([hit(f"{t}{i}", f"text {t} number {i} of its own kind") for i in range(3)] for t in "ab")
    assert [h["id"] for h in retrieval.merge({"a": a, "b": b}).hits] == ["a0", "b0", "a1", "b1", "a2", "b2"]
    same = retrieval.merge({"a": [hit("a", "the same words in both")], "b": [hit("b", "the same words in both", 0.5)]})
    assert [h["id"] for h in same.hits] == ["a"] and same.duplicates == [("b", "a")]
    words = " ".join(f"w{i}" for i in range(60))
    assert retrieval.similarity(words, words + " more") > 0.9 and retrieval.similarity("", "") == 1
    far = retrieval.merge({"a": [hit("x", "one two three four", distance=0.9, bm25_rank=None), hit("y", "five six seven eight", distance=0.9, bm25_rank=2)]}, max_distance=0.45)
    assert [h["id"] for h in far.hits] == ["y"] and far.too_far == 1


def test_context(spark):
    hits = [hit(f"h{i}", f"c{i} " + "word " * 200, label="text", source="a.md", rank=i) for i in range(7)]
    mixed = [hit("tiny", "x" * 50), hit("huge", "y" * 5000), hit("small", "z </context>" * 5)]
    mixed = [h | {"label": "l", "source": "s", "rank": i} for i, h in enumerate(mixed)]
    for case, budget, kept in ((hits, 1000, ["h0", "h1", "h2"]), (mixed, 300, ["tiny", "small"]), ([mixed[1]], 300, ["huge"]), (mixed[1:], 300, ["huge"]), ([], 300, [])):
        got = retrieval.build_context(spark, case, budget)
        assert [(i["number"], i["id"], i["tokens"], i["truncated"]) for i in got.items] == fold(case, budget)
        assert [i["id"] for i in got.items] == kept and got.dropped == [h["id"] for h in case if h["id"] not in kept] and got.tokens == sum(i["tokens"] for i in got.items)
        assert all(i["text"].endswith("[truncated]") == i["truncated"] and "</context>" not in i["text"] for i in got.items)


def test_keyword_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red car"), ("b", "blue car"), ("c", "green tree"), ("d", "tall tree"), ("e", "id X51005361900 tree")], "id string, text string")
    index = retrieval.KeywordIndex.build(docs)
    ask = spark.createDataFrame([(1, "red car"), (2, "x51005361900"), (3, "nothing here")], "qid int, text string")
    rows = index.search(ask, 3).orderBy("qid", "bm25_rank").collect()
    assert [(r["qid"], r["id"]) for r in rows] == [(1, "a"), (1, "b"), (2, "e")] and rows[0]["score"] > rows[1]["score"] > 0
    index.save(str(tmp_path / "i"))
    again = retrieval.KeywordIndex.load(spark, str(tmp_path / "i")).search(ask, 3).orderBy("qid", "bm25_rank").collect()
    assert [r["score"] for r in again] == pytest.approx([r["score"] for r in rows])
    cache = retrieval.IndexCache()
    for mark in ("f", "f", "g"):
        cache.get("t", mark, docs)
    assert cache.builds == 2


def test_hybrid_search(spark):
    texts = {"a": "ripe bananas", "b": "a fast red car", "c": "green trees grow slowly", "d": "cars and trucks on a road", "e": "unrelated words only"}
    rows = [(k, t, "text", hashed_words([t])[0]) for k, t in texts.items()]
    chunks = spark.createDataFrame(rows, "id string, text string, modality string, embedding array<double>")
    got = retrieval.hybrid_search(chunks, retrieval.KeywordIndex.build(chunks), "red cars", hashed_words(["red cars"])[0], 3).collect()
    assert got[0]["id"] in ("b", "d") and len(got) == 3 and [r["rank"] for r in got] == [1, 2, 3]
    assert retrieval.dense_search(chunks, hashed_words(["x"])[0], 9, modality="image").count() == 0


def test_citations(spark):
    assert strip_dangling("a [1] [7] [C3]", {1}, set()) == "a [1]"
    items = [{"id": "t/a/s0/0", "topic_id": "t", "source": "a.md", "modality": "text", "heading": "H"}, {"id": "t/a/s0/1", "topic_id": "t", "source": "a.md", "modality": "text", "heading": "H"}]
    got = build_citations("so [1] and [2] and [9]", True, [], [], items, [])
    assert got.sources[0].numbers == [1, 2] and got.sources[0].display == "t · a.md · section: H · text" and got.invalid == [9] and got.text == "so [1] and [2] and"
    df = spark.createDataFrame([("so [1] and [9] [C1] [C2]", [2], 2, [], [1])], "text string, used array<int>, n_items int, used_calculations array<int>, ok_calculations array<int>")
    r = check_markers(df).first()
    assert (r["valid"], r["invalid"], r["valid_calculations"], r["invalid_calculations"], r["clean_text"]) == ([1, 2], [9], [1], [2], "so [1] and [C1]")


def test_metrics(spark):
    got = spark.createDataFrame([(1, i, "t", f"s{i}", i, "some text") for i in range(1, 7)] + [(3, 1, "t", "s1", 1, "x")], "qid int, pos int, topic string, source string, page int, text string")
    want = spark.createDataFrame([(1, 1, "t", "s2", 2, None), (2, 1, "t", "s1", None, None)], "qid int, label int, topic string, source string, page int, contains string")
    rows = {r["qid"]: r for r in metrics.score_retrieval(got, want).collect()}
    assert rows[1]["precision"] == pytest.approx(1 / 6) and rows[1]["recall"] == 1
    assert rows[2]["precision"] == 0 and rows[2]["recall"] == 0 and rows[3]["recall"] is None
    runs = spark.createDataFrame([("a", True, 8.0, None), ("a", False, 9.0, "boom"), ("b", None, 13.0, None)], "category string, numbers_ok boolean, s double, error string")
    total = {r["category"]: r for r in metrics.summarize_run(runs, rates=["numbers_ok"], seconds="s").collect()}
    assert total[None]["is_total"] and total[None]["numbers_ok"] == 0.5 and total[None]["seconds_p95"] == 9.0 and total["b"]["numbers_ok"] is None
    assert {tuple(r["reasons"]) for r in metrics.failures(runs).collect()} == {("error", "numbers_ok")}
    v = spark.createDataFrame([(["present", "wrong", "missing", "present"], "partial")], "v array<string>, r string").select(metrics.share_of(F.col("v"), "present").alias("c"), metrics.relevance(F.col("r")).alias("r")).first()
    assert v["c"] == 0.5 and v["r"] == 0.5
