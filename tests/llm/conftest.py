import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, tid string, key string, words string, base string, spans string, start string"


def passage(n, seed):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls, empty, white and very long texts, copies, near copies, repeated rows, runs without spaces, personal data."""
    base, shared = passage(300, 1), passage(120, 2)
    texts = [
        None, "", "  \t\n ", "one", "two words", base, base, base.replace(base.split()[50], "changed", 1), base + " " + shared, passage(80, 3) + " " + shared + " " + passage(90, 4),
        "x" * 3000, "ab" * 2500, passage(20_000, 5), "Zoë ÉTÉ ünï 漢字 " * 120, "line one here\nline one here\n\nother # * | line\nline one here", shared + "\n" + shared, "a\x1cb \x85c  d\t\te", "it's  <|endoftext|> we'll\r\n GO",
        "mail a@b.c_x@d.ee and ..x@y-z.org, +1 (555) 010-9999 or +49 30 123456, 10.0.0.255 1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 378282246310005 " + "9" * 400, "Ä" + "é" * 450,
        "0" * 4000 + "@", "a." * 2000 + "@", "+1" + "-" * 3000 + "9", "the and of " * 60,
    ]
    rows = [(i if i != 4 else None, t, "en" if i % 3 else None, "s", None, "r", "t", "k", "w", "b", "s", "s") for i, t in enumerate(texts)]
    rows += [rows[5], rows[9], (7, "another text under an id in use", "de", None, 1, None, None, None, None, None, None, None), (None, base, "en", "s", 1, *["z"] * 7)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def both(odd, documents):
    """The driver's documents, with doc_ids moved, and the odd rows."""
    return documents.selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source").unionByName(odd.select("doc_id", "text", "lang", "source"))
