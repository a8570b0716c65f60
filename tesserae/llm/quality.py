"""Quality rules: base counts, and divergence of a document's distributions from its language's. DataFrame functions only.

Two histograms of each document, of its characters' classes and of its language's commonest words, are compared with
the language's own by the Jensen-Shannon distance (the root of the divergence in bits). The N_COMMON commonest words of
a language, those made of letters alone, are learned from all its documents. A language's first reference is the sum of
the histograms of all its documents that pass the base rules, gathered over the whole table; documents far from it are
left out of the second, which gives the verdict.

Texts shorter than the guards are not judged by a distance, as their histograms are noise. For words the limit follows
from the reference: n words drawn from it lie at about NOISE / sqrt(n) from it by chance, and a text without any common
word at a distance `most` that the share of common words sets. A text is judged if the first is half of the second at
most, and goes if it lies more than two thirds of the way from the first to the second.

Defined results: a null text is empty and fails for having under 10 words; null languages are one language of their own;
a language without common words has no word test; rows alike are judged alike; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.decontaminate import let
from tesserae.llm.spans import text_id
from tesserae.llm.work import small, written

_SPACE = r"[\x20\x09-\x0D]+"
N_COMMON = 12
#: Character classes, taken out of the text one after the other; what is left is the last class.
CLASSES = {"plain": "[a-z0-9]+", "space": _SPACE, "upper": "[A-Z]+", "symbol": "[#*$%&|<>=~^{}]+", "letter": "\\p{L}+"}
#: Least characters and words for each distance, and the distance of classes beyond which a document goes.
MIN_CHARS, MIN_WORDS = 200, 50
MOST_CLASSES = 0.18
#: sqrt(n) times the distance by chance of n words in N_COMMON + 1 classes.
NOISE = math.sqrt(N_COMMON / (8 * math.log(2)))


def language(c: Column | str = "lang") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def common_words(docs: DataFrame) -> DataFrame:
    """(l, list): the commonest words of each language, counted over all its documents; ties by the word."""
    words = docs.select(language().alias("l"), F.explode(F.split(F.coalesce("text", F.lit("")), _SPACE)).alias("w")).where(F.col("w").rlike(r"^\p{L}+$"))
    ranked = words.groupBy("l", "w").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w")))
    return ranked.where(F.col("r") <= N_COMMON).groupBy("l").agg(F.array_sort(F.collect_list(F.struct("r", "w")))["w"].alias("list"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, tid, lang, the base counts, and the histograms c0.. (character classes) and w0.. (common words)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("tid"), language().alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.join(small(written(common_words(docs), "common")), F.col("lang") == F.col("l"), "left").withColumn("list", F.coalesce("list", F.array().cast("array<string>")))
    d = d.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    d = d.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("wins", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(1), F.greatest(F.size("h") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("h", i, 5)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("wins")) == F.size("wins"), 0).otherwise(_covered(F.col("wins"))).cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", F.when(F.contains("text", F.lit("\n")), lines).otherwise(F.array().cast("array<string>"))).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"))
    rest, before = F.col("text"), "text"
    for i, pattern in enumerate(CLASSES.values()):
        d = d.withColumn(f"left{i}", F.regexp_replace(before, pattern, "")).withColumn(f"c{i}", (F.length(before) - F.length(f"left{i}")).cast("long"))
        before = f"left{i}"
    d = d.withColumn(f"c{len(CLASSES)}", F.length(before).cast("long"))
    d = d.withColumn("word_chars", F.length("text") - F.col("c1"))
    d = d.withColumn("rest", F.filter("words", lambda w: F.array_contains(F.col("list"), w))).withColumn("n_rest", F.size("rest"))
    for i in range(N_COMMON):
        before = "rest" if not i else f"rest{i - 1}"
        d = d.withColumn(f"rest{i}", F.when(F.size("list") > i, F.array_remove(before, F.get("list", F.lit(i)))).otherwise(F.col(before)))
        d = d.withColumn(f"w{i}", (F.size(before) - F.size(f"rest{i}")).cast("long"))
    d = d.withColumn(f"w{N_COMMON}", (F.col("n_words") - F.col("n_rest")).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.select("doc_id", "tid", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *_columns())


def _columns() -> list[str]:
    return [f"c{i}" for i in range(len(CLASSES) + 1)] + [f"w{i}" for i in range(N_COMMON + 1)]


def _covered(wins: Column) -> Column:
    """Words in windows of five that occur twice or more: equal windows stand side by side once sorted by hash."""

    def twice(s: Column) -> Column:
        n = F.size(s)
        return F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i + 1)["h"] == x["h"]) | (F.get(s, i - 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())

    def width(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1), x + 5) - x, F.lit(5))), F.lit(0), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, lambda s: F.array_sort(twice(s))), width)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays of counts); null if one is missing or empty."""

    def shares(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v), lambda total: F.transform(x, lambda v: F.try_divide(v.cast("double"), total.cast("double"))))

    def term(x: Column, both: Column) -> Column:
        return F.when(x > 0, 0.5 * x * F.ln(2 * x / both)).when(x.isNotNull(), 0.0)

    pairs = F.zip_with(shares(p), shares(q), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    total = F.aggregate(pairs, F.lit(0.0), lambda t, x: t + term(x["a"], x["a"] + x["b"]) + term(x["b"], x["a"] + x["b"]))
    return F.sqrt(F.greatest(total / F.ln(F.lit(2.0)), F.lit(0.0)))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, tid (of text_id()), the base counts, class_distance, common_distance, base_failed and kept of each document."""
    rows = written(features(docs), "features")
    first = _compared(rows, rows.where("not base_failed"))
    second = _compared(rows, first.where("not base_failed and not diverges"))
    return second.select("doc_id", "tid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("diverges")).alias("kept"), "class_distance", "common_distance")


def _compared(rows: DataFrame, good: DataFrame) -> DataFrame:
    """rows with both distances to the sums of the good rows of their language, and whether one is too large."""
    names = _columns()
    sums = written(good.groupBy("lang").agg(*(F.sum(c).alias(f"q_{c}") for c in names)).withColumnRenamed("lang", "q_lang"), "references")
    d = rows.join(small(sums), F.col("lang") == F.col("q_lang"), "left")
    of = {kind: [F.array(*(F.col(x + c) for c in names if c[0] == kind)) for x in ("", "q_")] for kind in "cw"}
    d = d.withColumn("class_distance", distance(*of["c"])).withColumn("common_distance", distance(*of["w"]))
    chars = F.aggregate(of["c"][0], F.lit(0).cast("long"), lambda a, v: a + v)
    odd = (chars >= MIN_CHARS) & (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASSES)
    none = F.array(*(F.lit(0 if i < N_COMMON else 1).cast("long") for i in range(N_COMMON + 1)))  # a text without a common word
    chance, most = F.try_divide(F.lit(NOISE), F.sqrt(F.col("n_words").cast("double"))), distance(none, of["w"][1])
    strange = (F.col("n_words") >= MIN_WORDS) & (2 * chance <= most) & (F.col("common_distance") > (chance + 2 * most) / 3)
    return d.withColumn("diverges", odd | F.coalesce(strange, F.lit(False)))
