"""Files of a topic to its chunk store and table store. A file that fails keeps the chunks it had; the others go on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.chunking import META, RECORD, chunk_records
from tesserae.operators.profile import table_records
from tesserae.operators.sync import ChunkStore, SyncStats
from tesserae.sources.files import route, topic_files
from tesserae.sources.html import text_records
from tesserae.sources.tables import TableStore, load_tables, tidy


@dataclass
class TopicReport:
    topic: str
    files: int = 0
    skipped: dict[str, str] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    stats: SyncStats | None = None


def ingest_topic(spark: SparkSession, data_dir: str, topic: str, chunks: ChunkStore, tables: TableStore, readers: dict | None = None) -> TopicReport:
    """readers: for `pdf` and `image`, functions from (spark, path, topic, source) to records; without one, such files fail."""
    files = route(topic_files(spark, data_dir)).where(F.col("topic_id") == topic).withColumn("safe", F.lit(True))
    listed = files.select("source", "kind", "skip_reason").collect()
    report = TopicReport(topic, len(listed), {r["source"]: r["skip_reason"] for r in listed if r["skip_reason"]})
    records: list[DataFrame] = [text_records(files.where("kind = 'text'"), F.col("content"), F.col("extension"))]
    kept: set[tuple[str, str]] = set()
    for r in listed:
        if r["kind"] in (None, "text"):
            continue
        path = f"{data_dir.rstrip('/')}/{topic}/{r['source']}"
        try:
            if r["kind"] == "table":
                for id_, df in load_tables(spark, path).items():
                    df = tidy(df)
                    if not df.columns or df.isEmpty():
                        continue
                    tables.save(df, topic, r["source"], id_)
                    kept.add((r["source"], id_))
                    records.append(table_records(tables.load(topic, r["source"], id_, rows=True), topic, r["source"], id_))
            elif readers and r["kind"] in readers:
                read = readers[r["kind"]](spark, path, topic, r["source"])
                kept |= {(r["source"], t["table_id"]) for t in read.where("table_id is not null").select("table_id").distinct().collect()}
                records.append(read)
            else:
                raise RuntimeError(f"no backend reads {r['kind']} files")
        except Exception as e:
            report.failed[r["source"]] = f"{type(e).__name__}: {e}"
    if not report.failed:
        tables.prune(topic, kept)
    columns = [c.split()[0] for c in RECORD.split(", ")]
    rows = records[0].select(columns)
    for more in records[1:]:
        rows = rows.unionByName(more.select(columns))
    new = chunk_records(rows.select("ordinal", "text", *META))
    report.stats = chunks.sync(topic, new, protected_sources=list(report.failed))
    return report
