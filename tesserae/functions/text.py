"""Text functions as Column expressions. Only Unicode normal forms, which Spark lacks, go through Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tesserae.config import DEFAULTS

#: Words that carry no meaning for keyword search.
STOPWORDS = (
    "a an the and or but if of to in on at by for with about as from into than that this these those it its is are was "
    "were be been being am do does did have has had having i you he she we they me my your our their who whom what which "
    "when where why how can could should would will shall may might must not no so such there here any all some more most "
    "other very just also then"
).split()
#: What counts as an amount stored as text, and as a hint of a date.
AMOUNT = r"^\s*(?:[A-Za-z]{0,3}\$|[€£¥₹]|RM|Rs\.?)?\s*-?\d[\d,]*(?:\.\d+)?\s*%?\s*$"
DATE_HINT = r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
#: Citations that stand in running text, as numbers in brackets and as authors with a year.
NUMBER_CITATION = r"\s?\[\d+(?:\s*[,–-]\s*\d+)*\]"
YEAR_CITATION = r"\s?\((?:[A-Z][A-Za-z'\-]+(?: et al\.?)?(?:,? (?:and|&) [A-Z][A-Za-z'\-]+)?,? (?:19|20)\d{2}[a-z]?(?:[;,] ?)?)+\)"
#: A letter, digit or underscore in any script.
WORD = r"[\p{L}\p{N}_]+"
_MARKS = r"[̀-ͯ]"


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _normalized(s: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        x = unicodedata.normalize("NFKD", x)
        return " ".join("".join(c for c in x if not "̀" <= c <= "ͯ").casefold().split())

    return s.map(one, na_action="ignore")


def normalize(c: Column) -> Column:
    """Accents, case and spacing folded away. ASCII text never leaves the JVM."""
    ascii_ = F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.when(c.isNull() | c.rlike(r"^\p{ASCII}*$"), ascii_).otherwise(_normalized(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))


def normalize_one(x: str) -> str:
    x = unicodedata.normalize("NFKD", x)
    return " ".join("".join(c for c in x if not "̀" <= c <= "ͯ").casefold().split())


def squash(c: Column) -> Column:
    """Like normalize(), without punctuation and stray symbols."""
    return F.btrim(F.regexp_replace(F.regexp_replace(normalize(c), "[^a-z0-9 ]", ""), " +", " "))


def clean(c: Column) -> Column:
    """Compatibility forms folded, LF line ends, no control characters, single spaces, trimmed lines, one blank line at most."""
    c = F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(nfkc(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(c, r"[ \t ]+", " ")
    c = F.regexp_replace(c, r"(?m)^ +| +$", "")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def to_number(c: Column) -> Column:
    """The number in an amount written as text: `$1,200.50` is 1200.5; null if what is left is no number."""
    return (F.regexp_replace(c, r"[^0-9.\-]", "")).try_cast("double")


def numeric(c: Column) -> Column:
    """The number that a text spells as a whole, else null."""
    c = F.btrim(c)
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


_DATE_FORMATS = (
    "yyyy-M-d H:m:s Z", "yyyy-M-d H:m:s XXX", "yyyy-M-d'T'H:m:sXXX", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d",
    "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy", "d/M/yyyy H:m:s", "d/M/yyyy", "yyyy/M/d H:m:s", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy",
    "M/d/yy", "d/M/yy", "d MMM yyyy", "d MMM yy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyy",
)


def to_instant(c: Column) -> Column:
    """A date in any of many spellings, months before days unless that is impossible, as an instant in UTC."""
    tidy = F.initcap(F.btrim(c))
    tidy = F.when(c.rlike("[A-Za-z]{3}") & ~c.rlike("[0-9]T[0-9]"), tidy).otherwise(F.btrim(c))
    return F.coalesce(*(F.try_to_timestamp(tidy, F.lit(f)) for f in _DATE_FORMATS))


def fold(c: Column) -> Column:
    """Lower case without combining marks; ASCII text never leaves the JVM."""
    low = F.lower(c)
    return F.when(low.rlike(r"^\p{ASCII}*$"), low).otherwise(F.regexp_replace(nfkd(F.when(~low.rlike(r"^\p{ASCII}*$"), low)), r"\p{M}", ""))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), 1)


#: Plural endings, the first that fits: the ending, the least length of the word, characters that go, and what comes instead.
PLURALS = ((r"ies$", 5, 3, "y"), (r"(ch|sh|x|z|ss)es$", 4, 2, ""), (r"(ss|us|is)$", 4, 0, ""), (r"s$", 4, 1, ""))


def stem(t: Column) -> Column:
    """A small stripper of plurals, by PLURALS; short words and those with digits stay."""
    out = F.when(~t.endswith("s") | t.rlike(r"\p{Nd}"), t)  # all plural endings end in s
    for ending, least, gone, instead in PLURALS:
        out = out.when(t.rlike(ending) & (F.length(t) >= least), F.concat(F.substring(t, F.lit(1), F.length(t) - gone), F.lit(instead)))
    return out.otherwise(t)


def keyword_tokens(c: Column) -> Column:
    """Tokens for keyword search: camelCase parted, stop words dropped, plurals stripped."""
    return F.transform(F.filter(tokens(parted(c)), lambda t: ~t.isin(*STOPWORDS)), stem)


def keywords(t: Column) -> Column:
    """The keyword of one token, null for a stop word: keyword_tokens() for a token in a row of its own."""
    return F.when(~t.isin(*STOPWORDS), stem(t))


def parted(c: Column) -> Column:
    """camelCase in its words."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?<=[a-z])(?=[A-Z])", " ")


def question_tokens(c: Column, boost: int = DEFAULTS.id_boost) -> Column:
    """Each distinct keyword of a question once; identifiers (three characters or more, with a digit) `boost` times."""
    def times(t: Column) -> Column:
        return F.array_repeat(t, F.when((F.length(t) >= 3) & t.rlike(r"\p{Nd}"), boost).otherwise(1))

    return F.flatten(F.transform(F.array_distinct(keyword_tokens(c)), times))


def shingles(c: Column, k: int = 3) -> Column:
    """The distinct word k-grams; a text of k words or fewer has its whole sequence as its one shingle."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), 1)

    def grams(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n <= k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(many))

    return F.transform(F.array(words), grams)[0]


def shingle_hashes(c: Column, k: int = 3) -> Column:
    """The distinct 64-bit hashes of what shingles() gives, without the texts."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), 1)

    def grams(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
        return F.when(n <= k, F.array(F.xxhash64(h))).otherwise(F.array_distinct(many))

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), grams)[0]


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def estimate_tokens(c: Column, chars: float = DEFAULTS.chars_per_token) -> Column:
    return F.ceil(F.length(c) / F.lit(chars)).cast("long")


def safe_name(c: Column) -> Column:
    x = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_"), F.lit("_"))
    return F.when(x == "", "x").otherwise(x)


#: Tags that wrap context and question, and the plain brackets that they become inside of these.
WRAPPERS = {f"<{end}{tag}>": f"[{end}{tag}]" for tag in ("context", "question") for end in ("/", "")}


def neutralise(c: Column) -> Column:
    """A text that cannot close or open the tags that it is wrapped in."""
    for tag, plain in WRAPPERS.items():
        c = F.replace(c, F.lit(tag), F.lit(plain))
    return c


def neutralised(text: str) -> str:
    """As neutralise(), for one text."""
    for tag, plain in WRAPPERS.items():
        text = text.replace(tag, plain)
    return text


def chunk_markers(c: Column) -> Column:
    """The numbers n of all markers [n]."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("int"))


def calculation_markers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[C(\d+)\]"), 1), lambda x: x.try_cast("int"))


def strip_markers(c: Column, valid: Column, valid_calculations: Column) -> Column:
    """Drop markers, and one space before them, whose number is not valid."""
    bad = F.array_distinct(F.filter(chunk_markers(c), lambda n: ~F.array_contains(valid, n)))
    bad_c = F.array_distinct(F.filter(calculation_markers(c), lambda n: ~F.array_contains(valid_calculations, n)))
    marks = F.concat(F.transform(bad, lambda n: F.concat(F.lit("["), n, F.lit("]"))), F.transform(bad_c, lambda n: F.concat(F.lit("[C"), n, F.lit("]"))))

    def drop(s: Column, m: Column) -> Column:
        return F.replace(F.replace(s, F.concat(F.lit(" "), m), F.lit("")), m, F.lit(""))

    return F.aggregate(marks, c, drop)


def numbers(c: Column) -> Column:
    """All numbers of an answer, without its markers; thousands separators are dropped."""
    plain = F.regexp_replace(c, r"\[C?\d+\]", "")
    found = F.regexp_extract_all(plain, F.lit(r"((?<![\p{L}\p{N}_.])-?\d[\d,]*(?:\.\d+)?)"), 1)
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def numbers_ok(answer: Column, expected: Column) -> Column:
    """Whether each expected (value, tol) has a number within tol; null if none is expected."""
    have = numbers(answer)
    return F.when(F.size(expected) > 0, F.forall(expected, lambda e: F.exists(have, lambda x: F.abs(x - e["value"]) <= F.coalesce(e["tol"], F.lit(0.0)))))


def plain_answer(c: Column) -> Column:
    """An answer without markers and thousands separators, its case and spacing folded: sharp s and its capital are ss."""
    bare = F.regexp_replace(c, r"\[C?\d+\]|(?<=\d),(?=\d{3})", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.upper(bare)), "ß", "ss"), r"\s+", " "))


def contains_all(answer: Column, needles: Column) -> Column:
    """Whether the answer has each needle, whatever the case, spacing and thousands separators; null if there are none."""
    text = plain_answer(answer)
    return F.when(F.size(needles) > 0, F.forall(needles, lambda n: F.contains(text, plain_answer(n))))


def hyphen_repair(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(\w)-\n(?=[a-z])", "$1")


def strip_citations(c: Column) -> Column:
    """Numeric and author-year citations go, with a space before them."""
    return F.regexp_replace(c, f"{NUMBER_CITATION}|{YEAR_CITATION}", "")
