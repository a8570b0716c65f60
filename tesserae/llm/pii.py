"""Personal data by patterns, and information-theoretic sanitisation around them. DataFrame functions only.

Base spans are the leftmost matches, without overlap, of one pattern for each kind; matches that fail their kind's
test are dropped. A protected entity is a kind with the matched value. Following Sanchez and Batet (2016), a term t
discloses an entity e if its pointwise mutual information with e reaches the share ALPHA of e's information content,
that is n(t, e) / n(t) >= (n(e) / N) ** (1 - ALPHA). N counts documents and n(t) documents with t, over the whole
table, n(e) those with e, and n(t, e) those with both, wherever t stands. Copies of a text count once, and so do
documents with e where t stands between the same BESIDE words on each side, so that boilerplate and near copies are no
evidence of their own. No least number of documents is asked for; instead the chance that so many of the documents
with t hold e if the two are independent, times the number of terms of e's documents, must be LEVEL at most. An
entity of one document is so disclosed by the words of that document alone, once the table is large enough. In a
document with e, every such t gets a span of kind `term`; terms are generalised or removed with the personal data.

The patterns equal the plain ones in what they match, but never scan a run of characters twice (possessive, and only
from a run's start or the end of the last match), so long runs cost no more than their length.

Defined results: a null text is empty; whole texts of any length are searched; offsets are code points, ends
exclusive; words are the lower-cased text between spaces, told apart by 64-bit hashes; rows with one doc_id share their terms; a null doc_id has no terms; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.decontaminate import let, words
from tesserae.llm.spans import text_id
from tesserae.llm.work import small, written

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]++"
#: Kinds in their order: the pattern, and a cheap test that every text with a match passes.
KINDS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}(?:\.{_DOMAIN})++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}+"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
ALPHA, LEVEL, BESIDE = 0.9, 0.01, 2
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _places(text: Column, pattern: Column | str, kind: int) -> Column:
    """All matches, with their places counted up from the pieces between them."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def counted(pieces: Column, found: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(found, i))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.get(found, i).alias("value")))).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>")), begin, step)["out"]

    return let(F.split(text, pattern, -1), lambda pieces: let(F.regexp_extract_all(text, pattern, 0), lambda found: counted(pieces, found)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _small_part(p: Column) -> Column:
    p = F.regexp_replace(p, "^0+", "")
    return (F.length(p) <= 3) & (F.coalesce(F.try_to_number(p, F.lit("999")), F.lit(0)) <= 255)


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), _small_part),
    "card": lambda x: F.length(_digits(x)).between(12, 19) & _luhn(_digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value), by start and then kind."""
    out = []
    for k, (kind, (pattern, hint)) in enumerate(KINDS.items()):
        may = F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)
        test = VALID[kind]
        found = F.filter(_places(text, pattern, k), lambda s: test(s["value"]))  # called at once, with this kind's test
        out.append(F.when(may, found).otherwise(F.array().cast(_SPAN)))
    both = F.concat(*out)
    return F.when(F.size(both) > 1, F.array_sort(both)).otherwise(both)


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _places_of_terms(masked: Column) -> Column:
    """Array of (t, c): the hash of each word, and of the BESIDE words on each side of it."""
    sides = [j for j in range(-BESIDE, BESIDE + 1) if j]
    return let(_hashes(masked), lambda h: F.transform(h, lambda t, i: F.struct(t.alias("t"), F.xxhash64(*(F.when(i + j >= 0, F.get(h, i + j)) for j in sides)).alias("c"))))


def _log_chance(k: Column, draws: Column, share: Column) -> Column:
    """Upper bound (Hoeffding) of the log of the chance that k or more of so many draws hit what has this share of all; for k over its mean."""
    a = k / draws
    return -draws * (a * F.ln(a / share) + F.when(a < 1, (1 - a) * F.ln((1 - a) / (1 - share))).otherwise(0.0))


def disclosing_terms(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(doc_id, terms array of hashes): for each document the terms that disclose one of its entities.

    docs: doc_id, text, tid. seen: doc_id, tid, entities and masked (the text without them) of those with an entity.
    """
    copies = written(docs.groupBy("tid").agg(F.count("*").alias("copies")), "copies")
    n = copies.count()
    own = seen.select("tid", F.explode("entities").alias("entity"), F.size(F.array_distinct(_hashes(F.col("masked")))).alias("n_terms")).groupBy("entity", "tid").agg(F.max("n_terms").alias("n_terms"))
    sizes = own.groupBy("entity").agg(F.count("*").alias("n_e"), F.sum("n_terms").alias("n_tests"))
    sizes = written(sizes.withColumn("least", F.pow(F.col("n_e") / F.lit(float(max(n, 1))), F.lit(1 - ALPHA))).withColumn("most", F.col("n_e") / F.col("least") + 1), "entities")
    most = sizes.agg(F.max("most")).first()[0] or 0.0  # a term in more documents than that discloses nothing
    once = docs.join(small(copies.where("copies > 1")), "tid", "left").select(F.explode(F.array_distinct(_hashes(F.col("text")))).alias("t"), (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    used = written(once.groupBy("t").agg(F.round(F.sum("weight")).cast("long").alias("n_t")), "used")
    often = used.where(F.col("n_t") > max(most, n / 100)).select("t")  # few; they would all meet in a few tasks
    places = seen.select("tid", F.inline(_places_of_terms(F.col("masked")))).join(small(often), "t", "left_anti").join(used.where(F.col("n_t") <= most), "t")
    met = places.join(small(seen.select("tid", F.explode("entities").alias("entity")).distinct()), "tid").join(small(sizes), "entity").where("n_t <= most")
    pairs = met.groupBy("entity", "t").agg(F.count_distinct("tid").alias("both"), F.count_distinct("c").alias("n_c"), *(F.max(c).alias(c) for c in ("n_t", "n_e", "n_tests", "least")))
    pairs = pairs.withColumn("n_te", F.least("both", "n_c")).withColumn("n_t", F.col("n_t") - F.col("both") + F.col("n_te"))
    te, t, e = F.col("n_te"), F.col("n_t"), F.col("n_e")
    chance = F.least(_log_chance(te, t, e / n), F.when(te / e > t / n, _log_chance(te, e, t / n)))
    told = pairs.where((te / t >= F.col("least")) & (te / t > e / n) & (chance + F.ln("n_tests") <= F.ln(F.lit(LEVEL))))
    told = written(told.select("entity", "t"), "told")
    of = seen.where("doc_id is not null").select("doc_id", F.explode("entities").alias("entity")).distinct()
    return of.join(small(told), "entity").groupBy("doc_id").agg(F.array_sort(F.collect_set("t")).alias("terms"))


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Whole words of the text that are terms, whatever their case, and overlap no base span."""
    quoted = F.array_join(F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![^\x20\x09-\x0D])(?:"), quoted, F.lit(r")(?![^\x20\x09-\x0D])"))
    return F.filter(_places(text, pattern, len(KINDS)), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def personal_data(docs: DataFrame) -> DataFrame:
    """docs' columns, with `base` and `spans` (arrays of start, kind, end, value) in place of any columns of those names."""
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_id().alias("tid"))
    found = plain.withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0)
    entities = F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"]))))
    seen = written(found.select("doc_id", "tid", entities.alias("entities"), sanitised(F.col("text"), F.col("base")).alias("masked")), "seen")
    terms = written(disclosing_terms(plain, seen), "terms").withColumnRenamed("doc_id", "of")
    own = F.coalesce(F.col("doc_id"), F.col("tid")) == F.col("of")  # so that null ids are spread over the tasks
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in kept)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_id().alias("tid"))  # so that no name clashes
    out = rows.withColumn("base", base_spans(F.col("text"))).join(small(terms), own & F.col("doc_id").isNotNull(), "left")
    told = F.filter(F.array_distinct(words(F.col("text"))), lambda w: F.array_contains(F.col("terms"), F.xxhash64(w)))
    more = let(told, lambda t: F.when(F.size(t) > 0, F.array_sort(F.concat("base", _term_spans(F.col("text"), t, F.col("base"))))).otherwise(F.col("base")))
    return out.select("row.*", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(more).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of each kind, the digest of the base spans, and all spans as text."""
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]  # noqa: B023
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span generalised to its kind: [EMAIL], [IP], [CARD], [PHONE]; terms to [NUMBER] or [TERM]."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(s: Column, x: Column) -> Column:
        name = F.when(x["kind"] < len(KINDS), F.get(names, x["kind"])).when(x["value"].rlike("^[0-9.,]+$"), F.lit("[NUMBER]")).otherwise(F.lit("[TERM]"))
        new = F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), name)).alias("out"))
        inside = F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))
        return F.when(x["start"] >= s["at"], new).otherwise(inside)

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
