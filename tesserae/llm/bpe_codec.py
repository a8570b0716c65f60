"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling gear hash over the text's bytes sets chunk borders, each moved on to the next space, so that passages that
documents share fall into the same chunks. The ids of a chunk are worked out once and kept, by a 128-bit digest, in a
memo of each worker that is bounded in bytes. Where two chunks meet, the words beside the join are encoded again as one
piece; if that does not agree with the chunks' own ids, the border goes, the two chunks are encoded again as one, and
the joins are tried again, until all agree exactly.

Defined results: a null text is empty and has no ids; texts of any length are taken whole; a null doc_id stays null;
repeated rows, and rows that share a doc_id, are each encoded; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.gear import gear_hash
from tesserae.llm.textbytes import LOWER, gathered, text_slices
from tesserae.llm.tokenizer import WordIds, kind_changes
from tesserae.llm.work import in_arrow

#: A chunk border on average every so many bytes (a power of 2).
CHUNK = 1024
#: Bytes of what is kept for chunks in a worker's memo, and what one more takes besides its ids.
CHUNK_MEMO, ENTRY = 24 << 20, 200
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True


def pieces(data: np.ndarray, edges: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and line end, cut at edges and changes of kind, and the edges' places among them."""
    solid = ~_CUT[data]
    first, last = solid.copy(), solid.copy()
    change = kind_changes(data, special)
    first[1:] &= ~solid[:-1] | change
    last[:-1] &= ~solid[1:] | change
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, edges)


class Codec:
    """Chunks of a tokenizer that drops white space and has no decoder, so that decoding joins the tokens by spaces."""

    def __init__(self, path: str):
        self.words = WordIds(path, 19)
        library = self.words.library
        if library.decoder is not None or "Lowercase" not in str(library.normalizer):
            raise ValueError("only tokenizers that lower case and have no decoder are joined by words")
        tokens = [(library.id_to_token(i) or "").encode() + b" " for i in range(library.get_vocab_size(with_added_tokens=True))]
        self.token_size = np.array([len(t) for t in tokens])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.chunks: dict[bytes, np.ndarray] = {}
        self.held = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each row has. edges: chunk borders, the rows' own ones included."""
        low = LOWER[data]
        if (low != data).any() and not any(x in low.tobytes() for x in self.words.special):
            data = low  # the tokenizer would do so itself
        while True:
            starts, ends, at = pieces(data, edges, self.words.special)
            raw = memoryview(data.tobytes())
            keys = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            fresh: dict[bytes, int] = {}
            for i, k in enumerate(keys):
                if k not in self.chunks:
                    fresh.setdefault(k, i)
            todo = np.fromiter(fresh.values(), np.int64, len(fresh))
            many = at[todo + 1] - at[todo]
            which = gathered(np.arange(len(starts)), at[todo], many)
            ids, sizes = self.words.encode(data, starts[which], ends[which])
            word_ends = np.concatenate([[0], np.cumsum(sizes)])
            chunk_ends = word_ends[np.concatenate([[0], np.cumsum(many)])]
            new = {k: ids[a:b].copy() for k, a, b in zip(fresh, chunk_ends[:-1].tolist(), chunk_ends[1:].tolist())}
            values = [self.chunks[k] if k in self.chunks else new[k] for k in keys]
            self._keep(new)
            bad = self._bad_joins(data, offsets, edges, starts, ends, at)
            if not len(bad):
                break
            edges = np.setdiff1d(edges, bad)
        size = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)])
        return np.concatenate([ids[:0], *values]), np.diff(size[np.searchsorted(edges, offsets)])

    def _keep(self, new: dict[bytes, np.ndarray]) -> None:
        self.held += sum(v.nbytes + ENTRY for v in new.values())
        if self.held > CHUNK_MEMO:
            self.chunks, self.held = {}, 0
        else:
            self.chunks |= new

    def _bad_joins(self, data: np.ndarray, offsets: np.ndarray, edges: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The borders inside rows where the words on both sides, encoded as one piece, have other ids than apart."""
        joins = np.flatnonzero(~np.isin(edges, offsets))
        joins = joins[(at[joins] > 0) & (at[joins] < len(starts))]
        row = np.searchsorted(offsets, edges[joins], "right") - 1
        left, right = at[joins] - 1, at[joins]
        inside = (starts[left] >= offsets[row]) & (ends[right] <= offsets[row + 1])  # a side without words has nothing to join
        joins, left, right = joins[inside], left[inside], right[inside]
        if not len(joins):
            return joins
        whole, n = self.words.encode(data, starts[left], ends[right])
        both = np.stack([left, right], 1).ravel()
        apart, m = self.words.encode(data, starts[both], ends[both])
        m = m.reshape(-1, 2).sum(axis=1)
        if len(whole) == len(apart) and (n == m).all() and (whole == apart).all():
            return joins[:0]
        a, b = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(m)])
        return edges[[j for i, j in enumerate(joins.tolist()) if not np.array_equal(whole[a[i] : a[i + 1]], apart[b[i] : b[i + 1]])]]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The tokens of each row, joined by spaces."""
        text = gathered(self.token_bytes, self.token_start[ids], self.token_size[ids])
        ends = np.concatenate([[0], np.cumsum(self.token_size[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        spare = ends[1:][sizes > 0] - 1  # the space after a row's last token
        offsets = ends - np.concatenate([[0], np.cumsum(sizes > 0)])
        return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.delete(text, spare))])


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def chunk_edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows' offsets, and the first space at or after each place where the gear hash says so."""
    spaces = np.flatnonzero(_CUT[data])
    marks = np.flatnonzero((gear_hash(data, offsets) >> np.uint32(32 - CHUNK.bit_length() + 1)) == 0)
    at = np.searchsorted(spaces, marks)
    return np.unique(np.concatenate([offsets, spaces[at[at < len(spaces)]]]))


def encode_decode(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each document, as the library encodes and decodes whole texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at, data, offsets in text_slices(batch, "text"):
                ids, sizes = own.encode(data, offsets, chunk_edges(data, offsets))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out = [batch.column(0).slice(at, len(sizes)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(out + [own.decode(ids, sizes)] * decode, ["doc_id", "ids"] + ["decoded"] * decode)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, ids array<int>" + ", decoded string" * decode)
