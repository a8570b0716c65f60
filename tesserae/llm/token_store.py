"""Token ids as binary blocks coded by a static range asymmetric numeral system (rANS, Duda, 2013).

Documents go by a range exchange into ascending doc_id order; each task's run is one file, of independent blocks of
whole documents. One frequency table, counted over all ids and scaled to 2**SCALE, is shared by all blocks. In a
block, token t belongs to lane t mod LANES; each lane has a state of its own and all share one stream of 32-bit words.
Every CHECKPOINT steps the lanes' states and the place in the stream are noted, so that a block can be decoded in
parts at the same time; a CRC-32 of the ids guards it.

Blocks are rows of a Parquet table (file, block, before, n_docs, n_tokens, payload), which any store that Spark
reaches can hold. A payload is little-endian: magic, lanes, steps between checkpoints, documents, tokens, words, CRC;
then the documents' ids, null marks and token counts, the first states, the checkpoints, the words.

Defined results: a null text is empty and has the end id alone; a null doc_id comes first; rows with one doc_id stand
in the order of their texts' CRC-32; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.textbytes import U64, list_array, text_slices
from tesserae.llm.tokenizer import byte_level, byte_level_spans
from tesserae.llm.work import dropped, in_arrow, new_path, small, written

SCALE, LANES, CHECKPOINT = 20, 1024, 64
#: Tokens after which a block is closed, at the end of a document.
BLOCK = 1 << 18
_HEAD = struct.Struct("<4sIIIQII")
_LOW = U64(1 << 31)
TOKENS = "file int, block int, before long, doc_ids array<long>, sizes array<int>, ids binary"
BLOCKS = "file int, block int, before long, n_docs int, n_tokens long, payload binary"


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for what occurs."""
    total, goal = int(counts.sum()), 1 << SCALE
    f = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * goal / max(total, 1)).astype(np.int64)), 0)
    while total and (rest := goal - int(f.sum())):
        most = np.argsort(-f, kind="stable")[: min(abs(rest), max(1, int((f > 1).sum())))]
        step = rest // len(most) if rest > 0 else -1
        f[most] += max(step, 1) if rest > 0 else step
        if rest > 0 and (over := int(f.sum()) - goal) > 0:
            f[most[0]] -= over
    return f.astype(np.uint64)


def encode_block(ids: np.ndarray, freq: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """States to start from, checkpoints [(place in the words, states)] from the front on, and the words."""
    f, c = freq[ids], first[ids]
    limit = f << U64(63 - SCALE)
    state = np.full(LANES, _LOW, U64)
    words, marks, n = [], [], 0
    for step in range(-(-len(ids) // LANES) - 1, -1, -1):
        s = slice(step * LANES, min(len(ids), (step + 1) * LANES))
        x = state[: s.stop - s.start]
        full = x >= limit[s]
        out = x[full]
        words.append(out.astype(np.uint32))
        n += len(out)
        x[full] = out >> U64(32)
        high, low = np.divmod(x, f[s])
        x[:] = (high << U64(SCALE)) + low + c[s]
        if step and step % CHECKPOINT == 0:
            marks.append((n, state.copy()))
    words = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return state, [(len(words) - at, x) for at, x in marks[::-1]], words


def decode_steps(state: np.ndarray, words: np.ndarray, n: int, symbol: np.ndarray, freq: np.ndarray, first: np.ndarray) -> np.ndarray:
    """n ids from the given states and words on."""
    out = np.empty(n, symbol.dtype)
    state, at, mask = state.copy(), 0, U64((1 << SCALE) - 1)
    for begin in range(0, n, LANES):
        x = state[: min(LANES, n - begin)]
        slot = x & mask
        ids = symbol[slot]
        out[begin : begin + len(x)] = ids
        x[:] = freq[ids] * (x >> U64(SCALE)) + slot - first[ids]
        need = x < _LOW
        k = int(np.count_nonzero(need))
        x[need] = (x[need] << U64(32)) | words[at : at + k]
        at += k
    return out


def pack(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, freq: np.ndarray, first: np.ndarray) -> bytes:
    state, marks, words = encode_block(ids, freq, first)
    head = _HEAD.pack(b"RNS1", LANES, CHECKPOINT, len(sizes), len(ids), len(words), zlib.crc32(ids.astype("<u4").tobytes()))
    null = np.array([x is None for x in doc_ids], np.uint8)
    parts = [np.array([x or 0 for x in doc_ids], "<i8"), null, sizes.astype("<u4"), state.astype("<u8")]
    for at, x in marks:
        parts += [np.array([at], "<u4"), x.astype("<u8")]
    return head + b"".join(p.tobytes() for p in [*parts, words.astype("<u4")])


def documents_of(payload: bytes) -> tuple[list, np.ndarray]:
    """doc_ids and sizes of a block, from its head alone."""
    docs, at = _HEAD.unpack_from(payload)[3], _HEAD.size
    ids, null = np.frombuffer(payload, "<i8", docs, at), np.frombuffer(payload, "u1", docs, at + 8 * docs)
    return [None if z else x for x, z in zip(ids.tolist(), null.tolist())], np.frombuffer(payload, "<u4", docs, at + 9 * docs)


def unpack(payload: bytes, symbol: np.ndarray, freq: np.ndarray, first: np.ndarray, part: int | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, sizes and ids of a block. With a part, only the ids between that checkpoint and the next are decoded."""
    magic, lanes, every, docs, n, n_words, crc = _HEAD.unpack_from(payload)
    if magic != b"RNS1" or lanes != LANES or every != CHECKPOINT:
        raise ValueError("not a block of this format")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    ids, null, sizes, state = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u8", lanes)
    steps = -(-n // lanes)
    marks = [(0, state)] + [(int(take("<u4", 1)[0]), take("<u8", lanes)) for _ in range(max(0, (steps - 1) // every))]
    words = take("<u4", n_words).astype(U64)
    doc_ids = [None if z else x for x, z in zip(ids.tolist(), null.tolist())]
    if part is not None:
        place, state = marks[part]
        return doc_ids, sizes, decode_steps(state, words[place:], min(n - part * every * lanes, every * lanes), symbol, freq, first)
    try:
        out = decode_steps(state, words, n, symbol, freq, first)
    except ValueError:  # the words ran out
        out = np.zeros(0, symbol.dtype)
    if len(out) != n or zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("the ids of a block do not match its checksum")
    return doc_ids, sizes, out


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of documents in ascending doc_id order; ids are little-endian unsigned 16-bit integers, or 32-bit beyond."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = byte_level(path)
        file, block, before, held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids, sizes, parts = [], [], []

        def closed() -> pa.RecordBatch:
            nonlocal block, before, held, doc_ids, sizes, parts
            ids = np.concatenate(parts).astype(f"<u{memo.kind().itemsize}").tobytes()
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.int32()), (block, pa.int32()), (before, pa.int64()), (doc_ids, pa.list_(pa.int64())), (sizes, pa.list_(pa.int32())), (ids, pa.binary()))], ["file", "block", "before", "doc_ids", "sizes", "ids"])
            block, before, held, doc_ids, sizes, parts = block + 1, before + held, 0, [], [], []
            return out

        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, data, offsets in text_slices(batch, "text"):
                starts, ends, words = byte_level_spans(data, offsets, memo.special)
                ids, n = memo.encode(data, starts, ends)
                row_ends = np.concatenate([[0], np.cumsum(n)])[words[1:]]
                ids = np.insert(ids, row_ends, end_id)
                row_ends += np.arange(1, len(row_ends) + 1)
                row = 0
                while row < len(row_ends):  # as many rows as the block still takes
                    begin = int(row_ends[row - 1]) if row else 0
                    to = min(len(row_ends), int(np.searchsorted(row_ends, begin + BLOCK - held)) + 1)
                    doc_ids += names[at + row : at + to]
                    sizes += np.diff(row_ends[row:to], prepend=begin).tolist()
                    parts.append(ids[begin : row_ends[to - 1]])
                    held += int(row_ends[to - 1]) - begin
                    row = to
                    if held >= BLOCK:
                        yield closed()
        if doc_ids:
            yield closed()

    order = ["doc_id", "crc"]
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.crc32(F.col("text").cast("binary")).alias("crc")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return in_arrow(ordered.select("doc_id", "text"), rows, TOKENS)


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, to: str | None = None) -> str:
    """Encode every document with the tokenizers library, append end_id, and write the blocks and their table; their folder."""
    spark = docs.sparkSession
    to = to or new_path(spark, "tokens")
    tokens = written(tokenized(docs, path, end_id), "ids")
    vocab = byte_level(path).library.get_vocab_size(with_added_tokens=True)
    kind = "<u2" if vocab <= 1 << 16 else "<u4"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocab, np.int64)
        for batch in batches:
            for x in batch.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=vocab)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["id", "n"])

    total = in_arrow(tokens.select("ids"), counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocab, np.int64)  # one number for each id of the vocabulary, whatever the size of the input
    for id_, n in total.collect():
        counts[id_] = n
    freq = scaled(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq long").coalesce(1).write.parquet(f"{to}/table")
    shared = spark.sparkContext.broadcast(freq)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        first = np.cumsum(freq, dtype=U64) - freq
        for batch in batches:
            for r in range(batch.num_rows):
                file, block, before, names, sizes = (batch.column(i)[r].as_py() for i in range(5))
                ids = np.frombuffer(batch.column(5)[r].as_buffer(), kind)
                row = (file, block, before, len(sizes), len(ids), pack(names, np.array(sizes), ids, freq, first))
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["file", "block", "before", "n_docs", "n_tokens", "payload"])

    in_arrow(tokens, coded, BLOCKS).write.option("compression", "none").parquet(f"{to}/blocks")
    dropped(tokens)
    return to


def _frequencies(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/table").collect()  # the vocabulary at most
    freq = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, U64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return freq


def read_documents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>) of the wanted doc_ids. Of a block only the parts between checkpoints that hold them are decoded."""
    shared = spark.sparkContext.broadcast(_frequencies(spark, folder))
    blocks = spark.read.parquet(f"{folder}/blocks")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                names, sizes = documents_of(payload)
                at = np.cumsum(sizes, dtype=np.int64) - sizes
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([file] * len(names), pa.int32()), pa.array([block] * len(names), pa.int32()), pa.array(at), pa.array(sizes.astype(np.int64))], ["doc_id", "file", "block", "at", "n"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        first = np.cumsum(freq, dtype=U64) - freq
        symbol, size = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)), CHECKPOINT * LANES
        for batch in batches:
            for payload, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                need = {k for p in places for k in range(p["at"] // size, (p["at"] + p["n"] - 1) // size + 1)}
                got = {k: unpack(payload, symbol, freq, first, k)[2] for k in sorted(need)}
                ids = []
                for p in places:
                    run = range(p["at"] // size, (p["at"] + p["n"] - 1) // size + 1)
                    ids.append(np.concatenate([got[k] for k in run])[p["at"] - run[0] * size :][: p["n"]].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([p["doc_id"] for p in places], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    index = in_arrow(blocks.select("file", "block", "payload"), listed, "doc_id long, file int, block int, at long, n long")
    places = index.join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    places = places.groupBy("file", "block").agg(F.collect_list(F.struct("doc_id", "at", "n")).alias("places"))  # of one block's documents
    return in_arrow(blocks.join(places, ["file", "block"]).select("payload", "places"), parts, "doc_id long, ids array<int>")


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids array<int>) of each document, decoded from the files."""
    shared = spark.sparkContext.broadcast(_frequencies(spark, folder))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        first = np.cumsum(freq, dtype=U64) - freq
        symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        for batch in batches:
            for file, before, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                names, sizes, got = unpack(payload, symbol, freq, first)
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                raw = memoryview(got.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                out = [pa.array([file] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(before + ends[:-1]), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [list_array(got.astype(np.int32), ends, pa.int32())] * ids, ["file", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    blocks = spark.read.parquet(f"{folder}/blocks")
    docs = in_arrow(blocks.select("file", "before", "payload"), decoded, "file int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row for each task of the range exchange
    files = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    out = docs.join(small(files), "file")
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * ids))
