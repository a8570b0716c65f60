"""The pipeline's rows against brute force, stage by stage."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tesserae.llm import oracle, quality

from ..oracle import duck_rows
from .test_operators import base_spans, roots, shingles

TAGS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]


@pytest.fixture(scope="module")
def ran(spark, sf_dir):
    return {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}


def test_rows(spark, sf_dir, documents, ran):
    kept = {r["doc_id"] for r in quality.judged(documents).where("kept").collect()}  # held against brute force elsewhere
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if r["doc_id"] in kept}
    sets = {d: shingles(t, 5) for d, t in texts.items()}
    links = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and 100 * len(x & y) >= 80 * len(x | y)]
    root = roots(texts, links)
    texts = {d: t for d, t in texts.items() if root[d] == d}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    items = [grams(words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {d: t for d, t in texts.items() if not any(100 * len(i & grams(words(t))) >= 80 * len(i) for i in items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, t in texts.items():
        out, at = "", 0
        for a, k, b in base_spans(t):
            if a >= at:
                out += t[at:a] + TAGS[k]
            at = max(at, b)
        want[d] = library.encode(out + t[at:], add_special_tokens=False).ids
    assert {d: r["ids"] for d, r in ran.items()} == want and 0 < len(want) < documents.count()


def test_ids_are_decoded(spark, sf_dir, ran, odd):
    """The last stage gives back the text of the ids, as the library decodes them."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*ran.values(), *corpus_pipeline.tokens(spark, odd, sf_dir).collect()]
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_documents_that_are_left(spark, sf_dir, ran):
    """Quality, near-duplicates and decontamination against their SQL, one on what the other kept."""
    sql = f"""with recursive {oracle.quality()}, kept1 as (select d.* from documents d join quality q on d.doc_id = q.doc_id where q.kept),
    {oracle.near_dup(5, 80, 'kept1')}, kept2 as (select k.* from kept1 k join near_dup n on k.doc_id = n.doc_id where n.kept),
    {oracle.contamination(5, 80, 'kept2')} select doc_id from kept2 where doc_id not in (select doc_id from contamination)"""
    assert {int(k[0]) for k in duck_rows(sf_dir, sql)[1]} == set(ran)


def test_stages_on_rows_of_their_own(spark, sf_dir):
    """Columns of any name, texts of several rows under one doc_id, and repeated rows."""
    words = " ".join(f"w{i} the" for i in range(60))
    rows = [(1, words, "a"), (1, words, "b"), (1, "quite another text " + " ".join(f"v{i}" for i in range(60)), "c"), (2, words + " more", "d"), (None, words, "e"), (None, None, "f"), (3, "", "g"), (4, "mail me@x.org now", "h")]
    names = ["doc_id", "text", "id", "i", "t", "tid", "row", "lang", "first", "several", "__id", "__tid", "__of", "__terms", "spans", "base", "of", "terms"]
    docs = spark.createDataFrame([(d, t, *[v] * 16) for d, t, v in rows], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    left = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in left.collect())
    one = {(1, "w0 th"), (2, "w0 th")} & set(kept)  # of the group that two texts of 1 and 2 are, which text of 1 counts as the first one is for its hash to say
    assert left.columns == names and len(one) == 1 and sorted(set(kept) - one) == [(0, ""), (0, "w0 th"), (1, "quite"), (3, ""), (4, "mail ")] and len(kept) == 6
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == names
    assert {r["text"] for r in corpus_pipeline.personal_data(spark, docs, sf_dir).where("doc_id = 4").collect()} == {"mail [EMAIL] now"}
    assert corpus_pipeline.tokens(spark, docs, sf_dir).count() == 8


def test_columns_and_stages(spark, sf_dir, documents, odd, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, empty):
            assert stage(spark, docs, sf_dir).columns == docs.columns
    assert corpus_pipeline.personal_data(spark, empty, sf_dir).count() == 0
    assert corpus_pipeline.tokens(spark, empty, sf_dir).count() == 0 and corpus_pipeline.tokens(spark, odd, sf_dir).count() == odd.count()
    assert corpus_pipeline.near_duplicates(spark, odd, sf_dir).where("doc_id = 5").count() == 1
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
