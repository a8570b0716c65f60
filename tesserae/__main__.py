"""python -m tesserae ingest DATA STORE [TOPIC ...] | ask DATA STORE QUESTION | chat DATA STORE | check DATA [STORE]"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from tesserae.operators.sync import ChunkStore, hashed_words
from tesserae.plans.answering import Answering, Topic
from tesserae.plans.ingest import ingest_topic
from tesserae.sources.files import topic_files, topics
from tesserae.sources.tables import TableStore


def session() -> SparkSession:
    return SparkSession.builder.appName("tesserae").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def environment(spark: SparkSession, data: str, store: str | None = None) -> dict[str, str | Exception]:
    """What each part of the environment says of itself, or the error that it gives."""

    def arrow() -> str:
        import pyarrow

        n = spark.range(3).mapInArrow(lambda batches: batches, "id long").count()
        return f"pyarrow {pyarrow.__version__}, {n} rows there and back"

    def writable() -> str:
        spark.range(1).write.mode("overwrite").parquet(f"{store}/_probe")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/_probe")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return store

    tests = {"spark": lambda: spark.version, "arrow": arrow, "embedder": lambda: f"{len(hashed_words(['one text'])[0])} dimensions", "topics": lambda: f"{topics(topic_files(spark, data)).count()} in {data}"}
    if store:
        tests["store"] = writable
    out: dict[str, str | Exception] = {}
    for name, test in tests.items():
        try:
            out[name] = test()
        except Exception as e:  # the others are still worth a look
            out[name] = e
    return out


def chat(answering: Answering, lines: Iterable[str], say=print) -> None:
    """Answers line by line, with what was said before, until an empty line."""
    history: list[dict] = []
    for line in lines:
        question = line.strip()
        if not question:
            break
        got = answering.answer(question, history)
        say(got.text)
        for s in got.citations.sources if got.citations else []:
            say(f"  {s.refs} {s.display}".rstrip())
        history += [{"role": "user", "content": question}, {"role": "assistant", "content": got.text}]


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("ingest", "ask", "chat", "check") or (args[0] != "check" and len(args) < 3):
        print(__doc__)
        return 2
    spark = session()
    if args[0] == "check":
        found = environment(spark, *args[1:3])
        for name, said in found.items():
            print(f"{name}: {type(said).__name__}: {said}" if isinstance(said, Exception) else f"{name}: {said}")
        return int(any(isinstance(x, Exception) for x in found.values()))
    known = [Topic(*r) for r in topics(topic_files(spark, args[1])).collect()]
    chunks, tables = ChunkStore(spark, f"{args[2]}/chunks"), TableStore(spark, f"{args[2]}/tables")
    if args[0] == "chat":
        chat(Answering(spark, known, chunks, tables), sys.stdin)
        return 0
    if args[0] == "ask":
        got = Answering(spark, known, chunks, tables).answer(" ".join(args[3:]))
        print(got.text, *(f"  {s.display}" for s in (got.citations.sources if got.citations else [])), got.trace, sep="\n")
        return int(got.status == "error")
    wanted = args[3:] or [t.id for t in known]
    if unknown := set(wanted) - {t.id for t in known}:
        print("unknown topics:", *sorted(unknown))
        return 2
    failed = False
    for t in wanted:
        r = ingest_topic(spark, args[1], t, chunks, tables)
        print(t, r.stats, *(f"\n  skipped {k}: {v}" for k, v in r.skipped.items()), *(f"\n  failed {k}: {v}" for k, v in r.failed.items()))
        failed |= bool(r.failed)
    return int(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
