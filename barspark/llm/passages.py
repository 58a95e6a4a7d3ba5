"""Substring dedup: passages that repeat, nearly, in other documents, by compact windows; exact.

A text is the row of its word shingles. Two windows of t shingles (words - width + 1) are alike if their Jaccard
similarity as multisets is at least the threshold: of 46 each, 41 in common (`need`). Documents with alike windows are
linked. The result has one row for each stretch of words of a document that windows alike to another
document's cover, with one such partner, and component_id, the least id that links reach. No sampling or chance
signature decides what is compared:

1. The texts that have a shingle are counted (to MOST at most), for all shingles: slices of texts deal 32 bits of each to
   buckets, which count and answer by place. Equal bits of unlike shingles only count more.
2. A window with less than `need` shingles that other texts have is alike to none. What the other windows hold, a
   document's reach, stays; on natural text this is little.
3. All shingles have one order: the rarest first, then by hash. Of two alike windows the t - need + 1 least of each
   have one in common. A compact window (l, c, r) here is a place c with the first and the last window that has it among its
   so many least; the shingle at c is its key. windows() is the case of the one least, by Cartesian trees.
4. Documents of a key meet the least of them, then up to ROUNDS others in seeded order, each time for those compact windows that no
   verified stretch holds; so a passage that thousands share makes a pair for each.
5. A window that still is in no verified stretch asks every document of its keys for what that holds there, and so do
   documents of a key for those of other components: how many of the window's shingles stand in the other's compact window. Where
   `need` do, the two meet. Documents whose compact windows hold the same answer as one. Only the asking is quadratic, in
   what has shared keys and is alike to none of the documents met: some hundred byte operations in numpy, no row.
6. A pair is compared in full, window by window, with no cut at an alignment.

Texts that are equal but for white space are one text; each copy gets a line that names the whole of it.

Defined cases: null ids take no part; null, empty and short texts have no passage; repeats inside
one document alone are not passages; rows with the same id count as one document; an empty table
gives an empty result; other columns are not looked at. Texts are used whole. Shingles are known by 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from . import columns, exact_dedup
from .columns import U64
from .components import components
from .support import BROADCAST_ROWS, done_with, saved

#: Texts with a shingle are counted up to here; a slice sends no more of one.
MOST = 100
#: Bytes of text in a slice, and in a bucket of shingles.
SLICE_BYTES, BUCKET_BYTES = 1 << 22, 1 << 25
#: Documents of a key that its others meet one after the other, before all meet.
ROUNDS = 4
#: Shingles of the documents that meet one hub in a task.
TOGETHER = 1 << 17
#: Pairs for which a task is made, and most tasks.
TASK_PAIRS, TASKS = 256, 2048
#: Starts of windows of one text and of another that are counted at once.
GRID = 1 << 18
#: Rows of a key in a part, and rows of small keys that a group holds, about.
BLOCK_ROWS = 4096
#: Bytes of a table of which shingles which rows hold.
TABLE = 1 << 26
#: Low bits of a sort key that hold the place in a slice; more where one text is longer.
PLACE_BITS = 21
SPAN = "doc_id long, partner_id long, start_word long, end_word long, partner_start long, partner_end long, jaccard double"
DEALT = "slice long, bucket int, data binary, docs binary, marks binary, firsts binary, again binary"
REACH = "doc long, n long, ranges binary, tokens binary, counts binary"
KEYS = "key long, doc long, l int, r int, same long"
ASKED = "key long, doc long, root long, ask boolean, shingles binary, open binary"


def windows(values: np.ndarray, firsts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of at least `least` values of every text of a slice: text number, l, c, r (places in the text).

    Texts stand between separators that are less than any value. Only places that are least in some stretch of just
    `least` values own a window that wide, and the neighbours that bound such a window own one too.
    """
    texts, n = len(firsts) - 1, len(values)
    lengths = np.diff(firsts)
    at = np.arange(n) + np.repeat(np.arange(texts), lengths) + 1  # one separator before each text
    size = n + texts + 1
    bits = max(PLACE_BITS, size.bit_length())
    keys = np.zeros(size, U64)
    keys[at] = (values >> U64(bits) << U64(bits)) | U64(1 << (bits + 1))
    keys |= np.arange(size, dtype=U64)
    is_separator = np.ones(size, bool)
    is_separator[at] = False
    padded = np.full(-(-(size + least) // least) * least, np.iinfo(U64).max, U64)
    padded[:size] = keys
    block = padded.reshape(-1, least)
    ahead = np.minimum.accumulate(block, 1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    least_of = np.minimum(back[: size - least + 1], ahead[least - 1 : size]) if size >= least else np.empty(0, U64)
    own = (least_of & U64((1 << bits) - 1)).astype(np.int64)
    own = own[np.flatnonzero(np.diff(own, prepend=-1))]
    place = np.union1d(own[~is_separator[own]], np.flatnonzero(is_separator))
    key, spot, separator = keys[place].tolist(), place.tolist(), is_separator[place].tolist()
    left, right, stack = [0] * len(spot), [size] * len(spot), []
    for k, v in enumerate(key):
        if separator[k]:
            for s in stack:
                right[s] = spot[k]
            stack = []
            edge = spot[k]
            continue
        while stack and key[stack[-1]] > v:
            right[stack.pop()] = spot[k]
        left[k] = spot[stack[-1]] if stack else edge
        stack.append(k)
    keep = np.flatnonzero(~np.array(separator, bool))
    c, lo, hi = place[keep], np.array(left, np.int64)[keep] + 1, np.array(right, np.int64)[keep] - 1
    wide = hi - lo + 1 >= least
    c, lo, hi = c[wide], lo[wide], hi[wide]
    starts = np.flatnonzero(is_separator)[:-1]
    text = np.searchsorted(starts, c) - 1
    base = starts[text] + 1
    return text, lo - base, c - base, hi - base


def _need(least: int, threshold: float) -> int:
    """Shingles that alike windows share at least."""
    return math.ceil(2 * least * threshold / (1 + threshold) - 1e-9)


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def dealt(tokens: np.ndarray, firsts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bucket (from 1) of each place of a slice, 0 where its shingle is not sent; the places that are sent, by bucket, and how many to each; and pairs (place, an earlier place of the text with its shingle).

    A text sends a shingle once, a slice MOST times.
    """
    order = np.argsort(tokens, kind="stable")
    text = (np.searchsorted(firsts, np.arange(len(order)), "right") - 1)[order]
    same = np.zeros(len(order), bool)
    same[1:] = tokens[order][1:] == tokens[order][:-1]
    again = same.copy()
    again[1:] &= text[1:] == text[:-1]
    here = np.arange(len(order))
    source = order[np.maximum.accumulate(np.where(again, 0, here))]
    upto = np.cumsum(~again)
    nth = upto - upto[np.maximum.accumulate(np.where(same, 0, here))]
    code = (((tokens >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.uint8 if buckets < 256 else np.uint16 if buckets < 1 << 16 else np.uint32) + 1
    code[order[again | (nth >= MOST)]] = 0
    places = np.argsort(code, kind="stable")
    sizes = np.bincount(code, minlength=buckets + 1)
    return code, places[sizes[0] :], sizes[1:], np.stack([order[again], source[again]]).astype(np.int32)


def _deal(width: int, buckets: int):
    """Of each slice a row with its documents and buckets by place (bucket -1), and a row for each bucket with 32 bits of every shingle."""

    def run(batches):
        n = 0
        for batch in batches:
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = columns.buffers(batch.column(2))
            for i, j in columns.slices(offsets, SLICE_BYTES):
                tokens, firsts = columns.shingles(*columns.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), width)
                code, places, sizes, again = dealt(tokens, firsts, buckets)
                short, upto = tokens[places].astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)])
                to = np.flatnonzero(sizes)
                name = (TaskContext.get().partitionId() << 32) + n
                n += 1
                none = [None] * len(to)
                blobs = [_bytes(code), *(_bytes(short[upto[b] : upto[b + 1]]) for b in to)]
                about = [pa.array([_bytes(x), *none], pa.binary()) for x in (ids[i:j].astype(np.int64), marks[i:j].astype(np.int64), firsts.astype(np.int64), again)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to) + 1, name)), pa.array(np.concatenate([[-1], to]).astype(np.int32)), pa.array(blobs, pa.binary()), *about], names=["slice", "bucket", "data", "docs", "marks", "firsts", "again"])

    return run


def _count(table: pa.Table) -> pa.Table:
    """How many texts sent each value of a bucket, to MOST at most, in the order in which the slices sent them."""
    blobs = table.column("data").to_pylist()
    values = np.frombuffer(b"".join(blobs), np.uint32)
    order = np.argsort(values)
    start = np.flatnonzero(np.diff(values[order], prepend=~values[order[:1]]))
    times = np.diff(np.append(start, len(values)))
    counts = np.empty(len(values), np.uint8)
    counts[order] = np.repeat(np.minimum(times, MOST), times)
    ends = np.cumsum([len(b) // 4 for b in blobs])
    return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "data": pa.array([_bytes(x) for x in np.split(counts, ends[:-1])], pa.binary())})


def held(flags: np.ndarray, firsts: np.ndarray, least: int, need: int) -> np.ndarray:
    """Starts of the windows of `least` places inside one text of which `need` are flagged."""
    if len(flags) < least:
        return np.empty(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(flags)])
    starts = np.flatnonzero(upto[least:] - upto[:-least] >= need)
    return starts[np.searchsorted(firsts, starts, "right") == np.searchsorted(firsts, starts + least - 1, "right")]


def _able(least: int, need: int):
    """Of a slice, the ranges of places that windows with `need` shingles that other texts have hold, by document, with the counts there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        blobs = table.column("data").to_pylist()
        docs, marks, firsts = (np.frombuffer(table.column(c)[0].as_py(), np.int64) for c in ("docs", "marks", "firsts"))
        size = int(firsts[-1])
        code = np.frombuffer(blobs[0], np.dtype(f"u{max(1, len(blobs[0]) // max(1, size))}"))
        counts = np.full(size, MOST, np.uint8)
        places = np.argsort(code, kind="stable")
        counts[places[int((code == 0).sum()) :]] = np.frombuffer(b"".join(blobs[1:]), np.uint8)
        again, source = np.frombuffer(table.column("again")[0].as_py(), np.int32).reshape(2, -1)
        counts[again] = counts[source]
        starts = held(counts > 1, firsts, least, need)
        new = np.flatnonzero(np.diff(starts, prepend=-least - 1) > least)
        text = np.searchsorted(firsts, starts, "right") - 1
        new = np.union1d(new, np.flatnonzero(np.diff(text, prepend=-1)))
        a, b = starts[new], starts[np.append(new[1:], len(starts)) - 1] + least if len(starts) else starts
        of = text[new]
        rows = []
        for k in np.unique(of):
            mine = of == k
            ranges = np.stack([a[mine], b[mine]], 1)
            rows.append((docs[k], marks[k], _bytes(ranges - firsts[k]), b"".join(_bytes(counts[x:y]) for x, y in ranges)))
        doc, mark, ranges, held_counts = zip(*rows) if rows else ((),) * 4
        return pa.table([pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(ranges, pa.binary()), pa.array(held_counts, pa.binary())], names=["doc", "mark", "ranges", "counts"])

    return run


def _reached(width: int):
    """REACH of rows (doc, text, ranges, counts)."""

    def run(batches):
        for batch in batches:
            data, offsets = columns.buffers(batch.column(1))
            for i, j in columns.slices(offsets):
                tokens, firsts = columns.shingles(*columns.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), width)
                ranges = batch.column(2).slice(i, j - i)
                kept = [np.concatenate([tokens[firsts[k] + a : firsts[k] + b] for a, b in np.frombuffer(r.as_py(), np.int64).reshape(-1, 2)]) for k, r in enumerate(ranges)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(t) for t in kept], pa.int64()), ranges, pa.array([_bytes(t) for t in kept], pa.binary()), batch.column(3).slice(i, j - i)], names=["doc", "n", "ranges", "tokens", "counts"])

    return run


def compact(rank: np.ndarray, starts: np.ndarray, least: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that are among the `count` least of a window that begins in starts (ascending), with the first and the last start of such a window."""
    first, last = np.full(len(rank), -1), np.full(len(rank), -1)
    views = np.lib.stride_tricks.sliding_window_view(rank, least) if len(rank) >= least else None
    for k in range(0, len(starts), 16_384):
        w = starts[k : k + 16_384]
        of = views[w]
        row, col = np.nonzero(of <= np.partition(of, count - 1, 1)[:, count - 1 : count])
        at = w[row] + col
        last[at] = w[row]  # of equal places the last one written stays
        once = np.full(len(rank), -1) if k else first
        once[at[::-1]] = w[row][::-1]
        if k:
            first = np.where(first >= 0, first, once)
    c = np.flatnonzero(first >= 0)
    return c, first[c], last[c]


def joined(tokens: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows (places ascending) of which those of one shingle that overlap or touch are one, as in text that repeats a line on and on."""
    order = np.argsort(tokens[c], kind="stable")
    c, lo, hi = c[order], lo[order], hi[order]
    new = np.ones(len(c), bool)
    new[1:] = (tokens[c[1:]] != tokens[c[:-1]]) | (lo[1:] > hi[:-1] + 1)
    new = np.flatnonzero(new)
    return c[new], lo[new], hi[np.append(new[1:], len(c)) - 1] if len(c) else hi


def _keys(least: int, need: int):
    """KEYS of the compact windows of every document: its shingle, the first and the last start of its windows, and a hash of all shingles that these hold."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, ranges, tokens, counts in zip(*(batch.column(c).to_pylist() for c in ("doc", "ranges", "tokens", "counts"))):
                ranges, tokens, counts = np.frombuffer(ranges, np.int64).reshape(-1, 2), np.frombuffer(tokens, U64), np.frombuffer(counts, np.uint8)
                firsts = np.concatenate([[0], np.cumsum(ranges[:, 1] - ranges[:, 0])])
                rank = (counts.astype(U64) << U64(56)) | (columns.mix64(tokens) >> U64(8))
                c, lo, hi = compact(rank, held(counts > 1, firsts, least, need), least, least - need + 1)
                again = counts[c] > 1
                c, lo, hi = joined(tokens, c[again], lo[again], hi[again])
                shift = (ranges[:, 0] - firsts[:-1])[np.searchsorted(firsts, c, "right") - 1]
                same = columns.segment_hashes(tokens, lo, hi - lo + least)
                out.append((tokens[c].view(np.int64), np.full(len(c), doc), (lo + shift).astype(np.int32), (hi + shift).astype(np.int32), same.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "doc", "l", "r", "same"])

    return run


class Line:
    """A document's reach on one line, its ranges `least` places apart so that no window and no stretch of one window's length holds two of them."""

    def __init__(self, ranges: bytes, tokens: bytes, least: int):
        self.ranges, self.tokens = np.frombuffer(ranges, np.int64).reshape(-1, 2), np.frombuffer(tokens, U64)
        size = self.ranges[:, 1] - self.ranges[:, 0]
        self.base = np.cumsum(size + least) - size - least
        inside = np.repeat(np.cumsum(size) - size, size)
        self.at = np.repeat(self.base, size) + np.arange(len(self.tokens)) - inside
        self.size = int((size + least).sum())
        self.whole = np.zeros(self.size, bool)  # where a window begins
        for b, n in zip(self.base, size):
            self.whole[b : b + n - least + 1] = True
        self.order = np.argsort(self.tokens, kind="stable")
        self.sorted = self.tokens[self.order]
        same = np.flatnonzero(self.sorted[1:] == self.sorted[:-1])
        near = self.at[self.order[same + 1]] - self.at[self.order[same]] < least
        x, y = self.at[self.order[same[near]]], self.at[self.order[same[near] + 1]]
        step = np.bincount(np.maximum(y - least + 1, 0), minlength=self.size + 1) - np.bincount(x + 1, minlength=self.size + 1)
        self.twice = np.cumsum(step)[: self.size] > 0  # windows that hold a shingle twice

    def place(self, at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.base, at, "right") - 1
        return at - self.base[k] + self.ranges[k, 0]


def _pairs(a: Line, b: Line) -> tuple[np.ndarray, np.ndarray]:
    """Every place of a and of b with the same shingle."""
    lo, hi = np.searchsorted(b.sorted, a.tokens, "left"), np.searchsorted(b.sorted, a.tokens, "right")
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.repeat(a.at, size), b.at[b.order[at]]


def alike(a: Line, b: Line, least: int, need: int, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of a that has `need` shingles or more, as a multiset, in common with a window of b; the start of such a window of b, and how many.

    pairs are _pairs(a, b) where these are known.
    """
    nothing = (np.empty(0, np.int64),) * 3
    p, q = pairs or _pairs(a, b)
    if len(p) < need:
        return nothing

    def inside(at):
        """How many of the places the window from each place holds."""
        flags = np.zeros(a.size + least + 1, np.int32)
        flags[at + 1] = 1
        upto = flags.cumsum()
        return upto[least:-1] - upto[: a.size]

    maybe = a.whole & (inside(p) >= need)
    if not maybe.any():
        return nothing
    best, start = np.zeros(a.size, np.int64), np.zeros(a.size, np.int64)
    shift = q - p
    order = shift.argsort(kind="stable")
    shift = shift[order]
    edge = np.flatnonzero(np.diff(shift, prepend=shift[0] - 1, append=shift[-1] + 1))
    times = np.diff(edge)
    for k in np.argsort(-times, kind="stable")[:16].tolist():
        if times[k] < need or not (maybe & (best == 0)).any():
            break
        both = inside(p[order[edge[k] : edge[k + 1]]])  # places side by side: as many in common at least
        ok = np.flatnonzero(maybe & (both >= need) & (both > best))
        best[ok], start[ok] = both[ok], ok + shift[edge[k]]
    left = maybe & (best == 0)
    if left.any():
        best, start = _moved(a, b, least, need, p, q, inside, best, start, left)
    good = np.flatnonzero(best >= need)
    last = b.base + b.ranges[:, 1] - b.ranges[:, 0] - least  # the last window of each range
    begin = start[good]
    k = np.maximum(np.searchsorted(b.base, begin + least - 1, "right") - 1, 0)
    return good, np.clip(begin, b.base[k], last[k]), best[good]


def _moved(a, b, least, need, p, q, inside, best, start, open_):
    """best and start with those of the open windows, of which no `need` shingles stand side by side in b."""
    far = np.iinfo(np.int64).max // 2
    many = np.flatnonzero(p[1:] == p[:-1])
    unsure = a.twice | (inside(p[many]) > 0) if len(many) else a.twice
    left = np.flatnonzero(open_ & ~unsure)
    if len(left):  # each shingle once in the window and once in b: any `need` of the places in b within one window's length
        of = np.full(a.size + least, far)
        of[p] = q
        rows = np.sort(np.lib.stride_tricks.sliding_window_view(of, least)[left], 1)
        fits = ((rows[:, need - 1 :] < far) & (rows[:, need - 1 :] - rows[:, : least - need + 1] < least)).any(1)
        left, rows = left[fits], rows[fits]
    if len(left):
        for common in range(need, least + 1):
            for k in range(least - common + 1):
                fits = (rows[:, k + common - 1] < far) & (rows[:, k + common - 1] - rows[:, k] < least)
                best[left[fits]], start[left[fits]] = common, rows[fits, k]
    left = open_ & unsure
    if left.any():  # what a window of b holds lies in two of its blocks of `least` places
        near = np.zeros(a.size, bool)
        block = q // least
        order = np.argsort(block, kind="stable")
        edge = np.searchsorted(block[order], np.arange(b.size // least + 3))
        for k in np.flatnonzero(edge[2:] - edge[:-2] >= need):
            near |= inside(p[order[edge[k] : edge[k + 2]]]) >= need
        left &= near
    left = np.flatnonzero(left)
    if len(left):  # of windows that hold the same shingles, as in text that repeats a line on and on, one is compared
        upto = np.zeros(a.size + least + 1, U64)
        upto[a.at + 1] = columns.mix64(a.tokens)
        upto = np.cumsum(upto)
        _, one, of = np.unique(upto[left + least] - upto[left], return_index=True, return_inverse=True)
        most, where, todo = np.zeros(a.size, np.int64), np.zeros(a.size, np.int64), np.sort(left[one])
        step = max(1, GRID // (b.size + least))
        for k in range(0, len(todo), step):
            w = todo[k : k + step]
            most[w], where[w] = _most_common(a, b, w, least)
        best[left], start[left] = most[left[one]][of], where[left[one]][of]
    return best, start


def _most_common(a: Line, b: Line, w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The most that each of the windows of a from w has in common with any window of b, and where.

    Where a window of a holds a shingle k times, a place of it in b counts in those windows of b that hold the place but not
    the k-th place of the shingle before it.
    """
    rows = np.lib.stride_tricks.sliding_window_view(a.tokens, least)[np.searchsorted(a.at, w)]
    known, of = np.unique(rows, return_inverse=True)
    times = np.bincount((np.arange(len(w))[:, None] * len(known) + of.reshape(rows.shape)).ravel(), minlength=len(w) * len(known)).reshape(len(w), -1)
    lo, hi = np.searchsorted(b.sorted, known, "left"), np.searchsorted(b.sorted, known, "right")
    size, head = hi - lo, np.cumsum(hi - lo) - (hi - lo)
    at = b.at[b.order[np.repeat(lo - head, size) + np.arange(int(size.sum()))]] + least  # b's places of these shingles, by shingle and place
    before = np.arange(len(at)) - np.repeat(times, size, axis=1)
    wide = b.size + least + 1
    begin = np.maximum(at - least, np.where(before >= np.repeat(head, size), at[np.maximum(before, 0)], 0))  # starts, `least` - 1 added
    plus = np.bincount((np.arange(len(w))[:, None] * wide + begin).ravel(), minlength=len(w) * wide).reshape(len(w), wide)
    common = (plus - np.bincount(at, minlength=wide)).cumsum(1)
    return common.max(1), common.argmax(1) - least + 1


def _verified(width: int, least: int, need: int):
    """SPAN of the hub of a group with each of its documents, and of these with it. A span is words that overlapping alike windows hold."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        lines = [(d, Line(r, t, least)) for d, r, t in zip(*(table.column(c).to_pylist() for c in ("doc", "ranges", "tokens")))]
        hub = table.column("hub")[0].as_py()
        for y in (x for d, x in lines if d == hub):
            for d, x in lines:
                if d != hub:
                    p, q = _pairs(x, y)
                    back = np.argsort(q, kind="stable")
                    for m, a, o, b, both in ((d, x, hub, y, (p, q)), (hub, y, d, x, (q[back], p[back]))):
                        w, j, common = alike(a, b, least, need, both)
                        if not len(w):
                            break  # none of a's is alike to b's, so none of b's to a's
                        w, j = a.place(w), b.place(j)
                        wide = least + width - 1
                        for g in np.split(np.arange(len(w)), np.flatnonzero(np.diff(w) > wide) + 1):
                            most = int(common[g].max())
                            rows.append((m, o, int(w[g[0]]), int(w[g[-1]]) + wide, int(j[g].min()), int(j[g].max()) + wide, most / (2 * least - most)))
        cols = list(zip(*rows)) or [()] * 7
        return pa.table([pa.array(c, pa.float64() if k == 6 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "partner_id", "start_word", "end_word", "partner_start", "partner_end", "jaccard"])

    return run


def repeated_passages(df: DataFrame, width: int = 5, words: int = 50, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of doc_id (words counted from 0) that windows of `words` words alike to other documents' cover, each with the partner of the most alike one met, and component_id."""
    ship(df.sparkSession)
    least = words - width + 1
    need = _need(least, threshold)
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    classes = saved(exact_dedup.exact_classes(docs, "doc", "text").select("doc", F.col("keep_id").alias("kept_doc")), "passage-classes")
    copies = saved(classes.where("doc <> kept_doc").distinct(), "passage-copies")
    lines = _copies(docs, copies, words)
    own = _only(classes, copies.select("doc")).where("doc = kept_doc").select("doc")  # ids with a text of their own besides
    gone = saved(copies.select("doc").distinct().join(own, "doc", "left_anti"), "passage-gone")
    docs = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc", "left_anti").where("text is not null").withColumn("mark", F.xxhash64("text"))

    reach = _reach(docs, width, least, need)
    keys = saved(reach.mapInArrow(_keys(least, need), KEYS), "passage-keys")
    order = (F.min_by("doc", F.xxhash64(F.lit(k), "doc")).alias(f"hub{k}") for k in range(1, ROUNDS))  # a number's hashes with one seed are all different
    hubs = keys.groupBy("key").agg(F.max("doc").alias("y"), F.min("doc").alias("hub0"), *order).where("hub0 < y").drop("y")
    met = saved(keys.join(hubs, "key"), "passage-met")
    left, pairs, found = met, None, None
    for k in range(ROUNDS):
        pairs, found = _compared(left.select("doc", F.col(f"hub{k}").alias("hub")), pairs, found, reach, width, least, need)
        left = saved(_uncovered(left, found, words), "passage-left")  # what is covered stays so
    roots = components(found.select("doc_id", "partner_id"), "doc_id", "partner_id").select(F.col("node").alias("doc"), "root")
    pairs, found = _compared(_rest(met, left, roots, found, reach, words, least, need), pairs, found, reach, width, least, need)
    roots = _grown(roots, found)
    roots = roots.withColumn("component_id", F.min("node").over(W.partitionBy("root"))).select(F.col("node").alias("doc_id"), "component_id")
    roots = saved(roots, "passage-components")
    out = _merged(found).join(roots, "doc_id")
    lines = lines.join(roots.withColumnRenamed("doc_id", "partner_id"), "partner_id", "left").withColumn("component_id", F.coalesce("component_id", "partner_id"))
    return out.unionByName(lines.select(*out.columns))


def _reach(docs: DataFrame, width: int, least: int, need: int) -> DataFrame:
    """REACH of the documents that have a window of which other texts have `need` shingles."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = saved(docs.select("doc", "mark", "text").mapInArrow(_deal(width, max(32, -(-size // BUCKET_BYTES))), DEALT), "passage-dealt")
    counts = sent.where("bucket >= 0").select("slice", "bucket", "data").groupBy("bucket").applyInArrow(_count, "slice long, bucket int, data binary")
    none = F.lit(None).cast("binary")
    both = sent.where("bucket < 0").unionByName(counts.select("*", none.alias("docs"), none.alias("marks"), none.alias("firsts"), none.alias("again")))
    able = saved(both.groupBy("slice").applyInArrow(_able(least, need), "doc long, mark long, ranges binary, counts binary"), "passage-able")
    done_with(sent)
    texts = _only(docs, able.select("doc")).join(able.dropDuplicates(["doc", "mark"]), ["doc", "mark"])
    return saved(texts.select("doc", "text", "ranges", "counts").mapInArrow(_reached(width), REACH), "passage-reach")


def _only(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows of the given documents; where these are few enough, without an exchange of the others."""
    ids = saved(docs.distinct(), "passage-ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc", "left_semi")


def _compared(pairs: DataFrame, before: DataFrame | None, found: DataFrame | None, reach: DataFrame, width: int, least: int, need: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (doc, hub) compared so far, in either order, and the spans found, with those of the new ones among pairs."""
    new = pairs.where("doc <> hub").distinct()
    if before is not None:
        new = new.join(before.unionByName(before.select(F.col("hub").alias("doc"), F.col("doc").alias("hub"))), ["doc", "hub"], "left_anti")
    new = saved(new, "passage-pairs")
    sizes = reach.groupBy("doc").agg(F.sum("n").alias("n"))
    parts = saved(new.join(sizes, "doc").groupBy("hub").agg(F.ceil(F.sum("n") / TOGETHER).cast("int").alias("parts")), "passage-parts")
    ours = new.join(parts, "hub").select("hub", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "doc")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("doc"))
    rows = ours.unionByName(hubs).join(reach.select("doc", "ranges", "tokens"), "doc")
    tasks = min(TASKS, 1 + new.count() // TASK_PAIRS)  # comparing is much work on few bytes
    spans = saved(rows.repartition(tasks, "hub", "part").groupBy("hub", "part").applyInArrow(_verified(width, least, need), SPAN), "passage-spans")
    return (new, spans) if before is None else (before.unionByName(new), found.unionByName(spans))


def _merged(found: DataFrame) -> DataFrame:
    """Spans of a document that overlap or touch are one; the partner is that of its most alike span, then of the longest, then the least."""
    by = W.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(by.rowsBetween(W.unboundedPreceding, -1))
    spans = found.withColumn("new", F.when(F.col("start_word") <= before, 0).otherwise(1))
    spans = spans.withColumn("n", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    partner = F.struct("jaccard", (F.col("end_word") - F.col("start_word")).alias("wide"), (-F.col("partner_id")).alias("id"), "partner_start", "partner_end")
    spans = spans.groupBy("doc_id", "n").agg(F.max(partner).alias("p"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return spans.select("doc_id", (-F.col("p.id")).alias("partner_id"), "start_word", "end_word", "p.partner_start", "p.partner_end", "p.jaccard")


def _uncovered(met: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """Compact windows some of whose words no verified span holds."""
    spans = _merged(found).select(F.col("doc_id").alias("of"), "start_word", "end_word")
    inside = (F.col("doc") == F.col("of")) & (F.col("l") >= F.col("start_word")) & (F.col("r") + words <= F.col("end_word"))
    return met.join(spans, inside, "left_anti")


def _cut(words: int, least: int):
    """ASKED of rows (doc, ranges, tokens, spans, asked): of each compact window asked for its shingles, 32 bits of each, and which of its windows are in no span."""

    def run(batches):
        for batch in batches:
            key, doc, root, ask, held, opens = ([] for _ in range(6))
            lists, spans = batch.column("asked"), batch.column("spans")
            asked = [lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("key", "l", "r", "root", "ask")]
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for d, name in enumerate(batch.column("doc").to_pylist()):
                ranges, tokens = np.frombuffer(batch.column("ranges")[d].as_py(), np.int64).reshape(-1, 2), np.frombuffer(batch.column("tokens")[d].as_py(), U64).astype(np.uint32)
                of, l, r, roots, asks = (x[ends[d] : ends[d + 1]] for x in asked)
                size = ranges[:, 1] - ranges[:, 0]
                k = np.searchsorted(ranges[:, 0], l, "right") - 1
                here = np.flatnonzero((k >= 0) & (r + least <= ranges[k, 1]))  # an id may have several texts
                at = l - ranges[k, 0] + (np.cumsum(size) - size)[k]
                span = np.array([(x["start_word"], x["end_word"]) for x in spans[d].as_py() or ()], np.int64).reshape(-1, 2)
                span = np.concatenate([[[-1, -1]], span[np.argsort(span[:, 0])]])
                seen = {}
                for i in here.tolist():
                    row, begin = tokens[at[i] : at[i] + r[i] - l[i] + least], np.arange(l[i], r[i] + 1 if asks[i] else l[i])
                    row = _bytes(row if asks[i] else np.unique(row))
                    free = begin + words > span[np.searchsorted(span[:, 0], begin, "right") - 1, 1]
                    known = seen.setdefault((of[i], roots[i], asks[i], row), [i, free])
                    known[1] = known[1] | free
                here = [i for i, _ in seen.values()]
                held += [row for *_, row in seen]
                opens += [_bytes(free) for _, free in seen.values()]
                for out, x in ((key, of[here]), (doc, np.full(len(here), name)), (root, roots[here]), (ask, asks[here])):
                    out.append(x)
            if held:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in (key, doc, root)), pa.array(np.concatenate(ask).astype(bool)), pa.array(held, pa.binary()), pa.array(opens, pa.binary())], names=["key", "doc", "root", "ask", "shingles", "open"])

    return run


def enough(has: np.ndarray, least: int, need: int) -> np.ndarray:
    """For each window of a row of shingles and for each other row, whether this holds `need` of the window's shingles; has says which of the shingles it holds."""
    upto = np.zeros((len(has) + 1, has.shape[1]), np.int16 if len(has) < 1 << 15 else np.int32)
    np.cumsum(has, 0, upto.dtype, upto[1:])
    return upto[least:] - upto[:-least] >= need


def _answers(asks: list[np.ndarray], held: list[np.ndarray], least: int, need: int):
    """(number of one of asks, numbers of rows of held, enough() of them), in pieces of bounded size."""
    step = max(1, TABLE // (8 * max(map(len, asks))))
    upto = np.cumsum([len(a) for a in asks])
    for i in range(0, len(held), step):
        some = held[i : i + step]
        row, every, k = np.repeat(np.arange(len(some)), [len(h) for h in some]), np.concatenate(some), 0
        while k < len(asks):
            end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + TABLE // len(some), "right")))
            known = np.unique(np.concatenate(asks[k:end]))
            at = np.minimum(np.searchsorted(known, every), len(known) - 1)
            there = known[at] == every
            has = np.zeros((len(known), len(some)), bool)
            has[at[there], row[there]] = True
            for n in range(k, end):
                yield n, np.arange(i, i + len(some)), enough(has[np.searchsorted(known, asks[n])], least, need)
            k = end


def _asked(least: int, need: int):
    """Pairs (doc, hub) of rows of a key that ask and others of which one may hold an alike window: an open one, or any if their components differ."""

    def run(table: pa.Table) -> pa.Table:
        key, doc, root, ask = (table.column(c).to_numpy() for c in ("key", "doc", "root", "ask"))
        held, opens = ([np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("shingles", np.uint32), ("open", bool)))
        order = np.lexsort((ask, key))
        pairs = [np.empty((2, 0), np.int64)]
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            asks, others = rows[ask[rows]], rows[~ask[rows]]
            if not len(asks) or not len(others):
                continue
            equal = {}
            for a in asks:
                equal.setdefault(held[a].tobytes(), []).append(a)
            equal = list(equal.values())
            for n, at, fits in _answers([held[x[0]] for x in equal], [held[b] for b in others], least, need):
                some = fits.any(0)
                if some.any():
                    for a in equal[n]:
                        b = others[at]
                        b = doc[b[fits[opens[a]].any(0) | (some & (root[b] != root[a]))]]
                        b = b[b != doc[a]]
                        pairs.append(np.stack([np.maximum(b, doc[a]), np.minimum(b, doc[a])]))
        pairs = np.unique(np.concatenate(pairs, 1), axis=1)
        return pa.table({"doc": pairs[0], "hub": pairs[1]})

    return run


def _rest(met: DataFrame, left: DataFrame, roots: DataFrame, found: DataFrame, reach: DataFrame, words: int, least: int, need: int) -> DataFrame:
    """Pairs of documents of a key of which one has an open window there of which the other has `need` shingles, or any such window if they lie in different components. A key's rows answer in blocks."""
    place = ["key", "doc", "l", "r"]
    rows = met.select(*place, "same").join(left.select(*place).distinct().withColumn("open", F.lit(True)), place, "left").join(roots, "doc", "left")
    rows = saved(rows.select(*place, "same", F.coalesce("open", F.lit(False)).alias("open"), F.coalesce("root", "doc").alias("root")), "passage-rest")
    keys = rows.groupBy("key").agg(F.max("open").alias("any"), F.min("root").alias("x"), F.max("root").alias("y"))
    keys = saved(keys.where("any or x < y").select("key"), "passage-rest-keys")  # of most keys nothing is left to compare
    rows = saved(rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key"), "passage-rest-rows")
    asks = rows.join(rows.groupBy("key").agg(F.mode("root").alias("most")), "key").where("open or root <> most")  # of two components one is not the most frequent
    at = F.struct("doc", "l", "r")
    held = rows.groupBy("key", "root", "same").agg(F.array_distinct(F.array(F.min(at), F.max(at))).alias("at"))  # two documents, so that one is another than who asks
    held = held.select("key", "root", F.inline("at"), F.lit(False).alias("ask"))
    asked = asks.select("key", "root", "doc", "l", "r", F.lit(True).alias("ask")).distinct().unionByName(held)
    asked = asked.groupBy("doc").agg(F.collect_list(F.struct("key", "l", "r", "root", "ask")).alias("asked"))
    spans = _merged(found).groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    cut = asked.join(reach.select("doc", "ranges", "tokens"), "doc").join(spans, "doc", "left").select("doc", "ranges", "tokens", "spans", "asked")
    cut = saved(cut.mapInArrow(_cut(words, least), ASKED), "passage-asked")
    groups = 1 + cut.count() // BLOCK_ROWS
    parts = saved(cut.groupBy("key").agg(F.ceil(F.count_if(~F.col("ask")) / BLOCK_ROWS).cast("int").alias("parts")), "passage-asked-parts")
    rows = cut.join(parts, "key").withColumn("all", F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("part", F.explode(F.when(F.col("ask"), F.col("all")).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")))))
    rows = rows.withColumn("group", F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups))))
    return rows.drop("parts", "all").groupBy("group", "part").applyInArrow(_asked(least, need), "doc long, hub long")


def _grown(roots: DataFrame, found: DataFrame) -> DataFrame:
    """node and root of all documents with a span: only links between the components of roots are contracted further."""
    links = found.select(F.col("doc_id").alias("x"), F.col("partner_id").alias("y")).distinct()
    for c in ("x", "y"):
        links = links.join(roots.select(F.col("doc").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    links = saved(links, "passage-links")
    more = components(links.select("x_root", "y_root"), "x_root", "y_root").select(F.col("node").alias("mid"), "root")
    nodes = links.select(F.col("x").alias("node"), F.col("x_root").alias("mid")).unionByName(links.select(F.col("y").alias("node"), F.col("y_root").alias("mid"))).distinct()
    return nodes.join(more, "mid", "left").select("node", F.coalesce("root", "mid").alias("root"))


def _copies(docs: DataFrame, copies: DataFrame, words: int) -> DataFrame:
    """A line for each copy of at least `words` words, as long as the text that stands for it."""
    copies = copies.where("doc <> kept_doc").distinct()
    heads = copies.select(F.col("kept_doc").alias("doc")).distinct()
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads
    sizes = docs.join(heads, "doc", "left_semi").select("doc", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"))
    sizes = saved(sizes.groupBy(F.col("doc").alias("kept_doc")).agg(F.max("n").alias("n")), "passage-sizes")
    zero = F.lit(0).cast("long")
    out = copies.join(sizes.where(F.col("n") >= words), "kept_doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("kept_doc").alias("partner_id"), zero.alias("start_word"), F.col("n").alias("end_word"), zero.alias("partner_start"), F.col("n").alias("partner_end"), F.lit(1.0).alias("jaccard"))
