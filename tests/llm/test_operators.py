"""Each operator against a plain brute-force version, on the driver's small table and on rows made to be awkward."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import bpe_codec, chunk_dedup, components, decontaminate, gear, lang_id, near_dup, pii, quality, queries, sharding, spans, suffix_dedup, textbytes, token_store, tokenizer, work
from tesserae.operators import joins

from .conftest import passage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def shingles(text, k):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(both, k, percent):
    rows = rows_of(both)
    sets = [(d, shingles(t, k)) for d, t in rows]
    full = [(d, s) for d, s in sets if d is not None and s]
    links = [(a, b) for i, (a, x) in enumerate(full) for b, y in full[:i] if x & y and 100 * len(x & y) >= percent * len(x | y)]
    root = roots({d for d, _ in rows if d is not None}, links)
    want = Counter((d, len(s), root.get(d), d is None or root[d] == d) for d, s in sets)
    got = near_dup.near_duplicates(both, k, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want


def test_near_duplicates_of_a_group_without_a_hub(spark):
    """Variants of one text, each near some others only: no link is lost though no star finds them all."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:j] + [f"x{j}"] + base[j + 1 :] if j % 3 else base[j // 3 :] + [f"t{i}" for i in range(j // 3)]) for j in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 3) for t in texts]
    links = [(a, b) for a in range(120) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(range(120), links)
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 3, 85).collect()} == want


@pytest.mark.parametrize(("few", "rounds"), [(0, 40), (0, 1), (16, 0)])
def test_near_duplicates_by_rounds_of_hubs(spark, monkeypatch, few, rounds):
    """However many rounds of hubs come before the rest is settled at once, the components are the same."""
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base[j // 2 :] + [f"t{i}" for i in range(j // 2)]) for j in range(90)] + [" ".join([f"v{i}" for i in range(20)] + [f"z{j}"] * 3 + [f"v{i}" for i in range(20, 140)]) for j in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 3) for t in texts]
    links = [(a, b) for a in range(130) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(range(130), links)
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 3, 85).collect()} == want and len(set(want.values())) > 1


def test_near_duplicates_shuffle_few_texts(spark, monkeypatch):
    """Texts that share no band with another one are not shuffled, also where joins are too large to be broadcast."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    texts = [passage(1000, 500 + i) for i in range(150)] + [passage(1000, 500), passage(1000, 501) + " more"]
    docs = work.written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")

    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = shuffled()
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = sum(n for stage, n in shuffled().items() if stage not in before)
    assert got == {i: i for i in range(150)} | {150: 0, 151: 1} and sent < 0.5 * sum(map(len, texts))


def test_likely_rows(spark):
    """A filter of values keeps every row that has one, few others, and no null."""
    rows = spark.range(20_000).selectExpr("nullif(id, 7) as x", "id as `a b`")
    for wanted in (spark.range(0, 20_000, 20), spark.range(0), spark.createDataFrame([(None,), (3,)], "id long")):
        got, want = {r["x"] for r in work.likely(rows, "x", wanted).collect()}, {r["id"] for r in wanted.collect()} - {None}
        assert want <= got and len(got - want) < 0.03 * 20_000 and None not in got
    assert work.likely(rows, "x", wanted).columns == rows.columns


def test_estimate_is_corrected_for_chance(spark):
    a, b = " ".join(f"a{i}" for i in range(1000)), " ".join(f"a{i}" if i < 900 else f"b{i}" for i in range(1000))
    sig = {r["doc_id"]: r["sig"] for r in near_dup.signatures(spark.createDataFrame([(1, a), (2, b), (3, " ".join(f"c{i}" for i in range(900)))], "doc_id long, text string"), 1, 0.8).collect()}
    n = near_dup.n_bands(0.8) * near_dup.ROWS
    df = spark.createDataFrame([(sig[1], sig[2], sig[3])], "x array<long>, y array<long>, z array<long>")
    near, far = df.select(near_dup.estimate(F.col("x"), F.col("y"), n), near_dup.estimate(F.col("x"), F.col("z"), n)).first()
    assert abs(near - 900 / 1100) < 0.15 and abs(far) < 0.12


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 99)] + [(200, 201), (201, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(100)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination(spark, both, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "one"), (901, ""), (902, None), (None, "x y z"), (903, "two words"), (900, "one")], "item_id long, text string"))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    docs, want = defaultdict(set), set()
    for d, t in rows_of(both):
        docs[d] |= grams(words(t))
    for r in items.collect():
        g = grams(words(r["text"]))
        want |= {(d, r["item_id"], len(g), len(g & s)) for d, s in docs.items() if None not in (d, r["item_id"]) and g and 100 * len(g & s) >= 80 * len(g)}
    got = decontaminate.contamination(both, items).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got} == want and len(got) == len(want) > 3
    assert decontaminate.contamination(both, items.limit(0)).count() == 0


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(both):
    got = sharding.shard_by_key(both, 16).collect()
    want = Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode()), jump(-1 if d is None else d, 16), jump(-1 if d is None else d, 17)) for d, t in rows_of(both))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_jump_hash(spark, n):
    keys = [0, 1, 2, -1, -(2**63), 2**63 - 1, 123456789012345, *range(10**6, 10**6 + 60)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("s"))
    assert {r["k"]: r["s"] for r in df.collect()} == {k: jump(k, n) for k in keys}


def test_quality_counts(both):
    def base(t):
        w = WORD.findall(t)
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many, seen = Counter(wins), Counter()
        covered = {i + j for i, x in enumerate(wins) if many[x] > 1 for j in range(5)}
        dup = 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += seen[line] > 0
                seen[line] += 1
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)

    got = quality.judged(both).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((d, *base(t)) for d, t in rows_of(both))
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_quality_verdict_keeps_clean_documents(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    got = quality.judged(spark.read.parquet(f"{d}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, False), 0) >= 5 * n.get((0, True), 0)


def test_quality_verdict_on_strange_words(spark, sf_dir):
    """Texts of 100 words or more without a common word, or in another language than they say, go; those of the language stay."""
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    good = quality.judged(docs).where("kept and n_words >= 120").join(docs, "doc_id")
    german = good.where("lang = 'de'").selectExpr("doc_id + 100000 as doc_id", "text", "'en' as lang")
    common = {r["l"]: r["list"] for r in quality.common_words(docs).collect()}
    assert {"the", "of", "and"} <= set(common["en"]) and {"der", "die", "und"} <= set(common["de"])
    bare = good.where("lang = 'en' and doc_id % 9 = 0").selectExpr("doc_id + 200000 as doc_id", rf"regexp_replace(text, '(?i)\\b({'|'.join(common['en'])})\\b', concat('x', doc_id)) as text", "lang")
    got = quality.judged(docs.unionByName(german).unionByName(bare)).where("doc_id >= 100000 and not base_failed").selectExpr("doc_id >= 200000 as bare", "kept").groupBy("bare").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    assert len(got) == 2 and all(r["n"] > 20 and r["kept"] < 0.1 for r in got)


def removed_by_windows(rows, length):
    places = defaultdict(list)
    for r, (_, t) in enumerate(rows):
        b = t.encode()
        for i in range(len(b) - length + 1):
            places[hashlib.blake2b(b[i : i + length], digest_size=12).digest()].append((r, i))
    gone = [np.zeros(len(t.encode()), bool) for _, t in rows]
    for at in places.values():
        if len(at) > 1:
            for r, i in at:
                gone[r][i : i + length] = True
    return gone


def digest_of(rows, gone):
    out = Counter()
    for (d, t), g in zip(rows, gone):
        edges = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
        kept = bytes(np.frombuffer(t.encode(), np.uint8)[~g])
        out[d, len(g), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "hot"), [(400, suffix_dedup.HOT), (400, 1), (120, 3)])
def test_suffix_dedup(both, length, hot):
    rows = rows_of(both.where("doc_id < 1060 or doc_id is null or doc_id >= 1150"))
    docs = both.where("doc_id < 1060 or doc_id is null or doc_id >= 1150")
    got = queries.removal(suffix_dedup.cut(docs, work.written(spans.merged_spans(suffix_dedup.repeated_spans(docs, length, hot)), "spans"))).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == digest_of(rows, removed_by_windows(rows, length))


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_removal_and_passages(both, monkeypatch, broadcast):
    """What is removed and what is counted as a passage, with and without broadcast joins."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", broadcast)
    docs = both.where("doc_id < 1060 or doc_id is null or doc_id >= 1150")
    rows = rows_of(docs)
    got = queries.removal(suffix_dedup.remove_repeats(docs, 400, 120), "passage_bytes").collect()
    long_, short = removed_by_windows(rows, 400), removed_by_windows(rows, 120)
    assert Counter((r["doc_id"], r["n_removed"], r["kept_sha256"], r["passage_bytes"]) for r in got) == Counter((d, int(g.sum()), hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~g])).hexdigest(), int(x.sum())) for (d, t), g, x in zip(rows, long_, short))


def test_suffix_order_rounds():
    """Fragments of one core: which windows recur at the same place."""
    rng = np.random.default_rng(3)
    core, out = bytes(rng.integers(97, 100, 30, dtype=np.uint8)), []
    for _ in range(60):
        d = int(rng.integers(0, 8))
        out.append((d, bytes(rng.integers(97, 99, d, dtype=np.uint8)) + core + bytes(rng.integers(97, 99, int(rng.integers(6, 12)), dtype=np.uint8))))
    length = 32
    d, n = np.array([x for x, _ in out]), np.array([len(s) - length + 1 for _, s in out])
    seen = Counter((x - i, s[i : i + length]) for x, s in out for i in range(len(s) - length + 1))
    got = suffix_dedup.repeated_columns(np.zeros(60, int), d, n, [s for _, s in out], length)
    assert [f.tolist() for f in got] == [[seen[x - i, s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for x, s in out]


def base_spans(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(both):
    kinds = ["email", "ip", "card", "phone"]
    got = pii.digest(pii.personal_data(both)).collect()
    want = Counter()
    for d, t in rows_of(both):
        t = t[:6000] if t.startswith("a.a.") else t
        s = base_spans(t)
        text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in s)
        want[(d, *(sum(x[1] == k for x in s) for k in range(4)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], *(r[f"n_{k}"] for k in kinds), r["base_sha256"]) for r in got) == want


def test_disclosing_terms(spark):
    """A word that stands beside one address in many contexts and hardly elsewhere is found; boilerplate is not."""
    rows = [(i, f"before{i} agent Zanzibar{'' if i % 2 else ','} me@x.org after{i} and zanzibar, again") for i in range(12)]
    rows += [(100 + i, "all rights reserved write to boiler@plate.org for leave") for i in range(30)]
    rows += [(200 + i, f"the agent number {i} said nothing of note and left on day {i}") for i in range(60)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    terms = Counter(s["value"].lower() for x in spans.values() for s in x if s["kind"] == 4)
    assert terms["zanzibar,"] >= 12 and "agent" not in terms and not any(s["kind"] == 4 for i in range(100, 130) for s in spans[i])
    clean = got.select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("t")).where("doc_id = 2").first()["t"]
    assert clean == "before2 agent [TERM] [EMAIL] after2 and [TERM] again"


def test_disclosing_terms_of_rare_entities(spark):
    """A name far from the one address it always comes with is found, though both are in two documents only; its copies are no evidence."""
    filler = lambda i: " ".join(f"word{(i * 7 + j * j) % 90}" for j in range(40))
    rows = [(i, f"{filler(i)} doc{i}") for i in range(1000)]
    rows += [(2000 + i, f"Quimby {filler(i)} is known to {filler(i + 50)} rare@x.org said{i}") for i in range(2)]
    rows += [(3000 + i, f"Ogilvy {filler(7)} wrote to once@x.org") for i in range(4)]
    rows += [(4000 + i, f"Bartleby {filler(i + 3)} wrote to us of often{i}@x.org") for i in range(8)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    terms = {r["doc_id"]: {s["value"] for s in r["spans"] if s["kind"] == 4} for r in got.where("doc_id >= 2000").collect()}
    assert "Quimby" in terms[2000] and "Quimby" in terms[2001] and "word1" not in terms[2000]
    assert all("Ogilvy" not in terms[3000 + i] for i in range(4)) and all("Bartleby" not in terms[4000 + i] for i in range(8))


def told_terms(rows):
    """For each doc_id the words that disclose one of its entities, by plain counting over all texts."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    texts = sorted({t for _, t in rows})
    n = len(texts)
    n_t = Counter(w for t in texts for w in set(words(t)))
    places, entities = {}, {}
    for t in texts:
        spans, out, at = base_spans(t), "", 0
        for a, k, b in spans:
            if a >= at:
                out += t[at:a] + ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"][k]
            at = max(at, b)
        masked = words(out + t[at:])
        entities[t] = {(k, t[a:b].lower()) for a, k, b in spans}
        pad = [None, None, *masked, None, None]
        places[t] = [(w, (*pad[i : i + 2], *pad[i + 3 : i + 5])) for i, w in enumerate(masked)] if spans else []
    own = defaultdict(list)
    for t in texts:
        for e in entities[t]:
            own[e].append(t)

    def log_chance(k, draws, share):
        a = k / draws
        return -draws * (a * math.log(a / share) + ((1 - a) * math.log((1 - a) / (1 - share)) if a < 1 else 0.0))

    told = defaultdict(set)
    for e, mine in own.items():
        n_e, tests = len(mine), sum(len({w for w, _ in places[t]}) for t in mine)
        least = (n_e / n) ** (1 - pii.ALPHA)
        texts_of, contexts = defaultdict(set), defaultdict(set)
        for t in mine:
            for w, c in places[t]:
                texts_of[w].add(t)
                contexts[w].add(c)
        for w, ts in texts_of.items():
            if w not in n_t or n_t[w] > n_e / least + 1:
                continue
            te = min(len(ts), len(contexts[w]))
            t = n_t[w] - len(ts) + te
            if te / t < least or te / t <= n_e / n:
                continue
            chance = log_chance(te, t, n_e / n)
            if te / n_e > t / n:
                chance = min(chance, log_chance(te, n_e, t / n))
            if chance + math.log(tests) <= math.log(pii.LEVEL):
                told[e].add(w)
    out = defaultdict(set)
    for d, t in rows:
        if d is not None:
            out[d] |= {w for e in entities[t] for w in told[e]}
    return out


def test_spans_of_terms(spark, sf_dir):
    """All spans, those of disclosing terms included, against plain counting over a whole table."""
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    more = [(9000 + i, f"Quimby wrote {i} times {'so ' * i}to quimby@x.org and signed Quimby") for i in range(6)] + [(9100, "once only@here.org said zyx"), (None, "nobody@x.org"), (9100, "once only@here.org said zyx")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows, kinds = rows_of(docs), ["email", "ip", "card", "phone", "term"]
    terms, want = told_terms(rows), Counter()
    for d, t in rows:
        base = base_spans(t)
        found = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if d is not None and m[0].lower() in terms[d] and not any(a < m.end() and m.start() < b for a, _, b in base)] if base else []
        want[d, ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(base + found))] += 1
    got = Counter((r["doc_id"], r["spans"]) for r in pii.digest(pii.personal_data(docs)).collect())
    assert got == want and sum("term" in s for _, s in got) > 5


def slow_borders(b):
    h, hashes = 0, []
    for c in b:
        h = ((h << 1) + int(gear.GEAR[c])) % 2**32
        hashes.append(h)
    w = chunk_dedup.REACH
    marks = [i + 1 for i in range(31 + w, len(b) - w) if (hashes[i], i) == max((hashes[j], j) for j in range(i - w, i + w + 1))]
    up = lambda m: next((j for j in range(m, len(b)) if b[j] & 0xC0 != 0x80), len(b))
    edges = sorted({0, len(b), *map(up, marks)})
    more = [up(x) for a, e in zip(edges, edges[1:]) for x in range(a + chunk_dedup.MOST, e, chunk_dedup.MOST)]
    edges = sorted({*edges, *more})
    return list(zip(edges, edges[1:]))


def test_passages_are_caught_wherever_they_stand(spark):
    """A passage of a little over 50 words in two texts of their own loses most of its second copy; the texts stay."""
    rng = np.random.default_rng(8)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))
    rows = []
    for i in range(60):
        p = text(52)
        rows += [(2 * i, f"{text(40)} {p} {text(30)}"), (2 * i + 1, f"{text(int(rng.integers(20, 60)))} {p} {text(25)}")]
    got = {r["doc_id"]: r for r in queries.removal(chunk_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(got[2 * i]["n_removed"] == 0 and got[2 * i + 1]["n_removed"] > 60 for i in range(60))


def test_chunk_dedup(both):
    rows = rows_of(both)
    chunks = [[(a, e) for a, e in slow_borders(t.encode()) if e - a > chunk_dedup.REACH] for _, t in rows]
    tid = {(r["doc_id"], r["text"] or ""): r["tid"] for r in both.select("doc_id", "text", chunk_dedup.text_id().alias("tid")).collect()}
    key = lambda d, t, a: (d is not None, d or 0, tid[d, t], a)
    first = {}
    for (d, t), cs in zip(rows, chunks):
        for a, e in cs:
            x = t.encode()[a:e]
            first[x] = min(first.get(x, key(d, t, a)), key(d, t, a))
    gone = []
    for (d, t), cs in zip(rows, chunks):
        gone.append(np.zeros(len(t.encode()), bool))
        for a, e in cs:
            gone[-1][a:e] |= first[t.encode()[a:e]] != key(d, t, a)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[-1].astype(np.int8), [0]])))
        for a, e in zip(edges[::2], edges[1::2]):
            gone[-1][a:e] &= e - a >= chunk_dedup.RUN
    got = queries.removal(chunk_dedup.remove_repeats(both)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == digest_of(rows, gone)


def test_language_identification(spark, sf_dir, odd):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    model = lang_id.learn(docs)
    odd_ = {(r["doc_id"], r["lang_pred"]): r["score"] for r in lang_id.predict(odd, *model).collect()}
    assert odd_[0, "und"] == odd_[1, "und"] == odd_[2, "und"] == 0
    assert lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()[0][0] == "und"
    assert np.count_nonzero(model[2]) < model[2].size / 2  # sparse


def slow_grams(text):
    c, out, mask = [ord(x) for x in text.lower()], [], (1 << 64) - 1
    h = [0] * len(c)
    for n in range(1, lang_id.GRAMS + 1):
        h = [((h[i] + c[i + n - 1] + n) * 0x9E3779B97F4A7C15) & mask for i in range(len(c) - n + 1)]
        h = [x ^ (x >> 31) for x in h]
        out += [(x >> 7) & (lang_id.FEATURES - 1) for x in h]
    return out


def test_language_model_by_plain_steps(spark, sf_dir):
    """The fit and the predictions against follow-the-regularised-leader over dicts, one weight at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    learned = sorted(((d, t, lang) for d, t, lang in rows if lang is not None and zlib.crc32(str(d).encode()) % 5), key=lambda r: (lang_id.hash_of(r[0]), r[0]))
    langs = sorted({r[2] for r in learned})
    counts = {t: Counter(slow_grams(t)) for _, t, _ in rows}
    df = Counter(g for _, t, _ in learned for g in counts[t])
    idf = lambda g: math.log((1 + len(learned)) / (1 + df[g])) + 1

    def vector(t):
        x = {g: (1 + math.log(k)) * idf(g) for g, k in counts[t].items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / size for g, v in x.items()}

    z, n = defaultdict(float), defaultdict(float)

    def weight(g, k):
        v = z[g, k]
        return 0.0 if abs(v) <= lang_id.L1 else -(v - math.copysign(lang_id.L1, v)) / ((lang_id.BETA + math.sqrt(n[g, k])) / lang_id.ALPHA + lang_id.L2)

    def shares(x, t=1.0):
        score = [sum(v * weight(g, k) for g, v in x.items()) / t for k in range(len(langs))]
        e = [math.exp(s - max(score)) for s in score]
        return [v / sum(e) for v in e]

    vectors = [vector(t) | {"one": 1.0} for _, t, _ in learned]
    for _ in range(lang_id.EPOCHS):
        for i, x in enumerate(vectors):
            if i % 5:
                p, y = shares(x), langs.index(learned[i][2])
                for g, v in x.items():
                    for k in range(len(langs)):
                        w, grad = weight(g, k), v * (p[k] - (k == y))
                        sigma = (math.sqrt(n[g, k] + grad * grad) - math.sqrt(n[g, k])) / lang_id.ALPHA
                        z[g, k] += grad - sigma * w
                        n[g, k] += grad * grad
    held = [(vectors[i], langs.index(learned[i][2])) for i in range(0, len(vectors), 5)]
    steps = [math.exp(math.log(0.05) + i / 59 * (math.log(5) - math.log(0.05))) for i in range(60)]
    best = min(steps, key=lambda t: -sum(math.log(shares(x, t)[y] + 1e-12) for x, y in held))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_id.identify(docs).collect()}
    for d, t, _ in rows:
        if any(map(str.isalpha, t or "")):
            p = shares(vector(t) | {"one": 1.0}, best)
            assert got[d][0] == langs[p.index(max(p))] and abs(got[d][1] - max(p)) < 1e-3


def test_many_languages(spark, monkeypatch):
    """Every language is learned, rare ones too; more than the bound are refused."""
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26) * 3} {chr(98 + i % 25) * 4} lorem {i}", f"l{i % 130}") for i in range(2600)], "doc_id long, text string, lang string")
    assert len(lang_id.learn(docs)[0]) == 130
    monkeypatch.setattr(lang_id, "LANGUAGES", 100)
    with pytest.raises(ValueError, match="100 languages"):
        lang_id.learn(docs)


def test_token_files(spark, both):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(rows_of(both), key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [library.encode(t, add_special_tokens=False).ids + [0] for _, t in rows]
    folder = token_store.write_tokens(both, path)
    got = token_store.read_tokens(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], tuple(r["ids"])) for r in got) == Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), tuple(x)) for (d, _), x in zip(rows, ids))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [d for d, _ in rows]
    some = spark.createDataFrame([(d,) for d in (1003, 12, 1150, 7, 999_999)], "doc_id long")
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in token_store.read_documents(spark, folder, some).collect()) == Counter((d, tuple(x)) for (d, _), x in zip(rows, ids) if d in (1003, 12, 1150, 7))


def test_blocks_decode_in_parts_and_check_sums():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 200_000) % 5000).astype(np.uint16)
    freq = token_store.scaled(np.bincount(ids, minlength=6000))
    assert int(freq.sum()) == 1 << token_store.SCALE and (freq[np.unique(ids)] > 0).all()
    first = np.cumsum(freq, dtype=np.uint64) - freq
    symbol = np.repeat(np.arange(6000, dtype=np.uint32), freq.astype(int))
    block = token_store.pack([1, None], np.array([150_000, 50_000]), ids, freq, first)
    assert token_store.unpack(block, symbol, freq, first)[2].tolist() == ids.tolist()
    size = token_store.CHECKPOINT * token_store.LANES
    parts = [token_store.unpack(block, symbol, freq, first, p)[2] for p in range(-(-len(ids) // size))]
    assert np.concatenate(parts).tolist() == ids.tolist() and len(parts) > 2
    assert token_store.documents_of(block)[0] == [1, None] and token_store.documents_of(block)[1].tolist() == [150_000, 50_000]
    with pytest.raises(ValueError, match="checksum"):
        token_store.unpack(block[:-3] + bytes([block[-3] ^ 1]) + block[-2:], symbol, freq, first)
    skewed = np.zeros(1000, np.int64)
    skewed[:3] = 10**12, 1, 1
    assert int(token_store.scaled(skewed).sum()) == 1 << token_store.SCALE


def test_bpe_codec(both):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(d, library.encode(t, add_special_tokens=False).ids) for d, t in rows_of(both)]
    got = bpe_codec.encode_decode(both, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == Counter((d, tuple(x), library.decode(x, skip_special_tokens=False)) for d, x in ids)


def test_bpe_joins_are_repaired():
    """Borders in the middle of words, more of them than a recursion could take, and beside spaces."""
    own = bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["some text that was cut in the middle of words, and put together", "w" * 3000, "  two   spaces \n\n and lines\n", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    edges = np.unique(np.concatenate([offsets, [7, 25, 41], np.arange(65, 3000, 2), np.arange(offsets[2], offsets[3])]))
    ids, sizes = own.encode(data, offsets, edges)
    want = [own.words.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert own.decode(ids, sizes).to_pylist() == [own.words.library.decode(x, skip_special_tokens=False) for x in want]


def test_word_table_is_bounded():
    """With room for few words, words are forgotten and encoded anew; the ids stay right."""
    own = tokenizer.WordIds(public_tokenizers.path("byte_bpe_50k.json"), bits=10)
    for seed in range(4):
        words = [f" w{(i * 7 + seed * 331) % 900}" for i in range(300)] + [" " + "long" * 100, " a"]
        ends = np.cumsum([len(w) for w in words])
        ids, sizes = own.encode(np.frombuffer("".join(words).encode(), np.uint8), ends - [len(w) for w in words], ends)
        want = [own.library.encode(w, add_special_tokens=False).ids for w in words]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert own.count <= 1 << 10


def test_word_hashes_tell_apart_what_polynomials_do_not():
    """Thue-Morse strings agree in any polynomial hash modulo 2**64, whatever its base."""
    bits = np.array([bin(i).count("1") & 1 for i in range(1024)], np.uint8)
    for size in (512, 1024):
        data = np.concatenate([bits[:size] + 97, 98 - bits[:size]])
        for seed in (0, 1, 7):
            a, b = textbytes.span_hashes(data, np.array([0, size]), np.array([size, 2 * size]), seed)
            assert a != b
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 2000, 3000)
    ends = starts + rng.integers(0, 1500, 3000)
    seen = {}
    for h, s, e in zip(textbytes.span_hashes(data, starts, ends).tolist(), starts.tolist(), ends.tolist()):
        assert seen.setdefault(h, data[s:e].tobytes()) == data[s:e].tobytes()
    assert len(seen) == len({data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())})


def test_empty_tables(empty, spark):
    for f in (near_dup.near_duplicates, sharding.shard_by_key, quality.judged, suffix_dedup.remove_repeats, pii.personal_data, chunk_dedup.remove_repeats, lang_id.identify):
        assert f(empty).count() == 0, f
    assert bpe_codec.encode_decode(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert token_store.read_tokens(spark, token_store.write_tokens(empty, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    assert decontaminate.contamination(empty, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
