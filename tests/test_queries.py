"""Every registered query of the engine against its SQL; those without SQL give rows."""

import random

import pytest

from tesserae import part_queries, queries  # noqa: F401
from tesserae.operators import retrieval

from .oracle import duck_rows, spark_rows
from .test_text import fold


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.SQL:
        assert spark_rows(df) == duck_rows(sf_dir, queries.SQL[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("block", [None, 1, 7])
def test_contexts_of_all_documents(spark, sf_dir, block):
    """Every document of a language is a candidate: the rows equal a plain fold over all of them."""
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, want = spark.read.parquet(f"{d}/documents.parquet"), set()
    hits = docs.selectExpr("lang as qid", "doc_id as rank", "cast(doc_id as string) as id", "'text' as label", "lang as topic_id", "source", "text")
    rows = [r.asDict() for r in hits.orderBy("rank").collect()]
    for lang in {r["qid"] for r in rows}:
        want |= {(lang, *x[:3]) for x in fold([r for r in rows if r["qid"] == lang], 6000)}
    got = retrieval.pack_all(hits, block=block) if block else queries.QUERIES["context_pack"](spark, d)
    assert {tuple(r) for r in got.collect()} == want


def test_near_copies_in_bounds(spark):
    """The first text alike, as by all pairs, of groups of any size, of chains and of texts that share a passage; and pairs that only share words are not built."""
    r = random.Random(3)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    changed = lambda w, n: [f"x{r.randrange(10**6)}" if i in set(r.sample(range(len(w)), n)) else x for i, x in enumerate(w)]
    passage, base, chain = some(60), some(200), some(150)
    lists = [passage + some(90) for _ in range(150)] + [changed(base, r.randrange(4)) for _ in range(60)] + [chain[i:] + some(i) for i in range(0, 60, 3)]
    lists += [x[: len(x) - r.randrange(25)] for x in lists[::5]] + [some(n) for n in range(30)] + [base] * 3 + [[], ["one"], ["one"]]
    r.shuffle(lists)
    texts = [" ".join(w) for w in lists]
    hits = [(q, 2 * i, i, t) for q in (0, 1) for i, t in enumerate(texts if q else texts[::-1])]

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    got = {tuple(x) for x in retrieval.near_copies(spark.createDataFrame(hits, "qid int, rank int, id int, text string")).collect()}
    sent = sum(n for stage, n in written().items() if stage not in before)
    want = set()
    for q in (0, 1):
        own = [(i, retrieval._grams(t, 3)) for k, _, i, t in hits if k == q]
        for i, x in own:
            like = next((j for j, y in own[:i] if min(len(x), len(y)) >= 0.9 * max(len(x), len(y)) and len(x & y) >= 0.9 * len(x | y)), None)
            want |= {(q, i, like)} if like is not None else set()
    assert got == want and len(want) > 100 and sent < 4 * sum(len(t) for *_, t in hits)
