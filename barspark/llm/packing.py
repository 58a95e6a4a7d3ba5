"""Packing documents into sequences along a space-filling curve.

Each document is encoded (operator 4) and ended by a token. Its token ids are hashed into a
signed vector of BUCKETS counts, damped by a square root, scaled to length 1 and projected
by a seeded random matrix to few dimensions; the Hilbert index of the projection's cell is
the document's key, so documents alike lie near one another on the curve. The encoded
documents are written once, in rows of at most CHUNK tokens, range-sorted by key (and by a
row number, so a key that many rows share is split too), and each task lays its rows end to
end and cuts the stream every `length` tokens. What is left at a task's end is cut into
powers of two, which need no padding: the bits of its length, largest first.

Defined cases: a null text counts as empty, and an empty text is its end token alone; null
and repeated ids and repeated rows are documents each; a text of any length is encoded
whole and then carried in bounded rows; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import bpe, columns
from .columns import U64
from .support import saved

#: Tokens in a sequence, in a row that is shuffled at most, and in a range of the curve about.
LENGTH, CHUNK, RANGE_TOKENS = 1024, 4096, 4 << 20
#: The end token, buckets of a hashed document vector, dimensions of the curve and bits of each.
END, BUCKETS, DIMS, BITS = 0, 256, 4, 12
#: A task's sequences are numbered from its own number times this.
TASK = 1 << 32


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole numbers below 2^bits (Skilling's transform, all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, below = 1 << b, (1 << b) - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def vectors(ids: np.ndarray, sizes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Each document's hashed vector, of length 1 (or 0 if it has no token)."""
    h = columns.mix64(ids.astype(U64) + U64(1))
    at = np.repeat(np.arange(len(sizes)) * buckets, sizes) + (h % U64(buckets)).astype(np.int64)
    v = np.bincount(at, 1.0 - 2.0 * (h >> U64(63)).astype(float), len(sizes) * buckets).reshape(len(sizes), buckets)
    v = np.sign(v) * np.sqrt(np.abs(v))
    return v / np.maximum(np.sqrt((v * v).sum(1)), 1e-12)[:, None]


def projection(seed: int, buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims))


def keys(ids: np.ndarray, sizes: np.ndarray, matrix: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each document's place on the curve. A projected coordinate is about normal, so a logistic curve spreads it over the cells."""
    z = vectors(ids, sizes, len(matrix)) @ matrix
    return hilbert(np.minimum(((1 + np.tanh(0.8 * z)) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def with_ends(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The documents' ids one after another, an end token after each."""
    out = np.full(len(ids) + len(sizes), END, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(sizes + 1) - 1] = False
    out[own] = ids
    return out


def id_type(vocabulary: bpe.Vocabulary) -> np.dtype:
    """How ids travel: in two bytes where all ids of the vocabulary fit."""
    return np.dtype("<u2" if vocabulary.size <= 1 << 16 else "<u4")


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 13) -> DataFrame:
    """id_col, start, doc_tokens, key, ids: each document's ids in rows of at most CHUNK tokens, as little-endian integers of id_type()."""
    ship(df.sparkSession)
    loaded = bpe.load(path)
    vocabulary = df.sparkSession.sparkContext.broadcast(loaded)  # a vocabulary file of a few MB
    kind = id_type(loaded)
    matrix = projection(seed)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("key", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        encoder = bpe._encoder(vocabulary.value)
        for batch in batches:
            data, offsets = columns.buffers(batch.column(1))
            for i, j in columns.slices(offsets):
                ids, sizes = bpe._encode(encoder, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key, stream, sizes = keys(ids, sizes, matrix), with_ends(ids, sizes), sizes + 1
                rows = -(-sizes // CHUNK)
                doc = np.repeat(np.arange(len(sizes)), rows)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)) * CHUNK
                first = (np.cumsum(sizes) - sizes)[doc] + start
                stream = columns.large_strings(stream.astype(kind).view(np.uint8), np.append(first, sizes.sum()) * kind.itemsize, pa.large_binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(start), pa.array(sizes[doc]), pa.array(key[doc]), stream.cast(pa.binary())], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def cuts(total: int, length: int, last: bool) -> np.ndarray:
    """Ends of the sequences of a stream; with last also those of the rest, in powers of two."""
    whole = np.arange(length, total + 1, length)
    rest = total % length if last else 0
    bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.concatenate([whole, total - rest + np.cumsum(bits)]).astype(np.int64)


class Stream:
    """Rows laid end to end; what does not fill a sequence waits for the rows after it."""

    def __init__(self, length: int):
        self.length, self.number = length, 0
        self.docs: pa.Array | None = None

    def _joined(self, docs: pa.Array, start: np.ndarray, tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        if self.docs is None:
            return docs, start, tokens, ids, sizes
        return pa.concat_arrays([self.docs, docs]), *(np.concatenate(x) for x in zip(self.rest, (start, tokens, ids, sizes)))

    def cut(self, docs: pa.Array, start: np.ndarray, tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray, last: bool = False) -> list[pa.Array]:
        """Columns of all pieces in sequences that are full now (last: of all): document, start, length, doc_tokens, sequence, offset, ids."""
        docs, start, tokens, ids, sizes = self._joined(docs, start, tokens, ids, sizes)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        ends = cuts(int(begin[-1]), self.length, last)
        done = int(ends[-1]) if len(ends) else 0
        edge = np.union1d(begin[begin <= done], np.append(ends, 0))
        at, length = edge[:-1], np.diff(edge)
        row, seq = np.searchsorted(begin, at, "right") - 1, np.searchsorted(ends, at, "right")
        offset = at - np.concatenate([[0], ends])[seq]
        data = columns.large_strings(ids[:done].astype("<u4").view(np.uint8), edge * 4, pa.large_binary())
        out = [docs.take(pa.array(row)), pa.array(start[row] + at - begin[row]), pa.array(length), pa.array(tokens[row]), pa.array(self.number + seq), pa.array(offset), data.cast(pa.binary())]
        self.number += len(ends)
        k = int(np.searchsorted(begin, done, "right")) - 1  # the row that the next sequence begins in
        into = done - begin[k] if k < len(sizes) else 0
        start, sizes = start[k:].copy(), sizes[k:].copy()
        start[:1] += into
        sizes[:1] -= into
        self.docs, self.rest = docs.slice(k), (start, tokens[k:], ids[done:], sizes)
        return out


def _packed(length: int, names: list[str], kind: np.dtype):
    def run(batches):
        stream, base, empty = Stream(length), TaskContext.get().partitionId() * TASK, None

        def rows(cols):
            cols[4] = pa.array(cols[4].to_numpy() + base)
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            data, offsets = columns.buffers(b.column(3))
            empty = b.column(0).slice(0, 0)
            yield rows(stream.cut(b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(), data.view(kind).astype("<u4"), np.diff(offsets) // kind.itemsize))
        if empty is not None:
            none = np.empty(0, np.int64)
            yield rows(stream.cut(empty, none, none, none.astype("<u4"), none, last=True))

    return run


def pack(df: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", seed: int = 13, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row per piece of a document in a sequence: id_col, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit integers)."""
    rows = saved(encoded(df, path, id_col, text_col, seed).withColumn("row", F.monotonically_increasing_id()), "packing-rows")
    total = rows.agg(F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("n")).first()["n"] or 0
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in names[1:-1]], T.StructField("ids", T.BinaryType())])
    order = rows.repartitionByRange(max(1, -(-total // range_tokens)), "key", "row").sortWithinPartitions("key", "row")
    return order.select(id_col, "start", "doc_tokens", "ids").mapInArrow(_packed(length, names, id_type(bpe.load(path))), schema)


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sequence_id, ids (all of the sequence, at most its length) and documents (offset, id_col, start, length of each piece)."""
    piece = F.struct("offset", id_col, "start", "length", "ids")
    all_ = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece), lambda a, b: F.signum(a["offset"] - b["offset"]).cast("int")).alias("p"))  # `length` pieces at most
    ids = F.aggregate("p", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    return all_.select("sequence_id", ids.alias("ids"), F.transform("p", lambda p: F.struct(p["offset"].alias("offset"), p[id_col].alias(id_col), p["start"].alias("start"), p["length"].alias("length"))).alias("documents"))
