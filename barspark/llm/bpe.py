"""Byte-level BPE encoding by speculation and verification, and decoding.

Texts are cut into words for a whole slice of a column at once (character classes in
numpy). Each distinct word is looked up by hash; a new one is proposed as its greedy
longest-match tokens. A sequence of tokens is what merging gives if and only if every
adjacent pair is: a vectorised check walks back the merges at the border of all new
pairs together. Only words with a failing pair are merged exactly. Decoding gathers the
tokens' bytes.

Defined cases: null counts as empty, and an empty text has no token; the strings of a
vocabulary's added tokens are those tokens wherever they stand; repeated rows and ids do
not matter (rows are independent); an empty table gives an empty result; columns but the
id and the text are not looked at. One text is always held whole, never cut.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import columns
from .columns import U64

# The code points of the Unicode property White_Space.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, NUMBER, OTHER, CUT = range(5)
#: Code points that no text can hold: between texts, and in place of an added token.
BETWEEN, ADDED = 0xD800, 0xD801
NEVER = np.int64(1) << 40
#: Words that a worker remembers before it forgets all.
REMEMBERED = 250_000
#: The longest word that is merged together with others.
TOGETHER = 48


def byte_of_letter() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: bytes that print stand for themselves, the others follow U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """A map of whole numbers of at least 0, looked up and added to for whole arrays: open addressing in a table that is at most half full."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.used = 0
        self._resize(len(key))
        self.add(key, value)

    def _resize(self, n: int) -> None:
        bits = max(4, (2 * n).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(U64) * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys that the table does not hold."""
        self.used += len(key)
        if 2 * self.used > len(self.keys):
            there = self.keys >= 0
            key, value = np.concatenate([self.keys[there], key]), np.concatenate([self.values[there], value])
            self._resize(2 * self.used)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key
            self.values[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], (slot[~placed] + 1) & self.mask

    def get(self, key: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], -1)
        on = np.flatnonzero((there != key) & (there >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            there = self.keys[slot[on]]
            same = there == key[on]
            out[on[same]] = self.values[slot[on[same]]]
            on = on[~same & (there >= 0)]
        return out


class Vocabulary:
    """Arrays of a byte-level BPE read from a tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, letters = spec["model"], byte_of_letter()
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normaliser is asked for")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word borders are not provided for")
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.made = np.full(size, -1, np.int64)  # the rank of the merge that makes a token
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if self.made[z] >= 0:
                raise ValueError("two merges make one token")
            self.made[z], self.left[z], self.right[z] = rank, x, y
            self.merges[x, y] = rank, z
        self.of_rank = np.array([z for _, z in self.merges.values()], np.int64)
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys, self.pair_ranks = size, keys[order], ranks[order]
        self.of_byte = [0] * 256
        for i, t in enumerate(self.bytes):
            if len(t) == 1 and self.made[i] < 0:
                self.of_byte[t[0]] = i
        special = set(self.added.values())
        self.ids = {t: i for i, t in enumerate(self.bytes) if t and i not in special}
        nodes: dict[int, int] = {}  # a tree of all tokens' bytes: node * 256 + byte -> node
        token = [-1]
        for t, i in self.ids.items():
            at = 0
            for c in t:
                at = nodes.setdefault(at << 8 | c, len(token))
                if at == len(token):
                    token.append(-1)
            token[at] = i
        self.token_at, self.steps = np.array(token, np.int64), Table(*(np.fromiter(x, np.int64, len(nodes)) for x in (nodes.keys(), nodes.values())))
        self.byte_id = np.array(self.of_byte, np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def propose(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words (byte ranges of data) together: tokens one after another, and how many each word has.

        Every word walks the tree of tokens, a byte a step. One that cannot go on gives the last token that it passed and begins anew behind it.
        """
        word = np.arange(len(first))
        at, node, until = first.copy(), np.zeros(len(first), np.int64), end.copy()
        token, behind = np.full(len(first), -1), first.copy()
        words, tokens = [], []
        while len(word):
            inside = at < until
            next_ = np.where(inside, self.steps.get(node << 8 | data[np.minimum(at, len(data) - 1)]), -1)
            go = next_ >= 0
            node, at = np.where(go, next_, 0), at + go
            found = np.where(go, self.token_at[node], -1)
            hit = found >= 0
            token, behind = np.where(hit, found, token), np.where(hit, at, behind)
            if go.all():
                continue
            stop = np.flatnonzero(~go)
            words.append(word[stop])
            tokens.append(token[stop])
            at[stop] = behind[stop]
            left = go | (behind < until)
            word, at, node, until, token, behind = (x[left] for x in (word, at, node, until, token, behind))
        if not words:
            return np.empty(0, np.int64), np.zeros(len(first), np.int64)
        words = np.concatenate(words)
        return np.concatenate(tokens)[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(first))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a's and b's bytes gives just a and b.

        Backwards in time, the later made of the two tokens at the border falls apart again and again. While a pair
        stands at the border, a merge of it must not come before the first merge that ends it; of equal merges the left one is first.
        """
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        a_ends, b_ends = np.full(len(a), NEVER), np.full(len(a), NEVER - 1)
        while len(open_):
            rank = self.ranks(a, b)
            bad = (rank < a_ends) & (rank <= b_ends)
            good[open_[bad]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~bad & ((made_a >= 0) | (made_b >= 0))
            undo_a = made_a > made_b
            a_ends, b_ends = np.where(undo_a, made_a, a_ends)[go], np.where(undo_a, b_ends, made_b)[go]
            a, b, open_ = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go], open_[go]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost, by a heap over linked places."""
        ids: list[int | None] = [self.of_byte[c] for c in word]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := merges.get((z, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, z, ids[after[j]], m[1]))
            if before[i] >= 0:
                h = before[i]
                if m := merges.get((ids[h], z)):
                    heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [t for t in ids if t is not None]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair (NEVER if there is none)."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def merge_together(self, found: list[bytes]) -> list[list[int]]:
        """Exact merging of many short words at once: each round makes the lowest, leftmost merge of every word."""
        sizes = np.array([len(w) for w in found], np.int64)
        width, rows = int(sizes.max()), np.arange(len(found))
        ids = np.zeros((len(found), width), np.int64)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(found), np.uint8)]
        rank = np.full((len(found), width), NEVER)
        both = np.flatnonzero(inside[:, 1:])
        r, c = both // (width - 1), both % (width - 1)
        rank[r, c] = self.ranks(ids[r, c], ids[r, c + 1])
        out: list[list[int]] = [[] for _ in found]
        while len(rows):
            at = rank.argmin(1)
            least = rank[np.arange(len(rows)), at]
            done = least == NEVER
            for k, row, n in zip(rows[done].tolist(), ids[done].tolist(), sizes[done].tolist()):
                out[k] = row[:n]
            go = ~done
            rows, ids, rank, sizes, at, least = rows[go], ids[go], rank[go], sizes[go] - 1, at[go], least[go]
            if not len(rows):
                break
            line = np.arange(len(rows))
            merged = self.of_rank[least]
            move = np.minimum(np.arange(width) + (np.arange(width) > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, move, 1), np.take_along_axis(rank, move, 1)
            ids[line, at] = merged
            has = at + 1 < sizes
            rank[line, at] = NEVER
            rank[line[has], at[has]] = self.ranks(merged[has], ids[line[has], at[has] + 1])
            has = at > 0
            rank[line[has], at[has] - 1] = self.ranks(ids[line[has], at[has] - 1], merged[has])
            rank[line, sizes - 1] = NEVER
        return out

    def encode_words(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words one after another, and how many each has: proposed, checked all together, and merged where a pair fails."""
        flat, sizes = self.propose(data, first, end)
        ends = np.cumsum(sizes)
        inner = np.ones(len(flat), bool)
        inner[ends[sizes > 0] - 1] = False
        at = np.flatnonzero(inner)
        if not len(at):
            return flat, sizes
        pairs, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back]
        failing = np.unique(np.searchsorted(ends, at[~good], "right"))
        if not len(failing):
            return flat, sizes
        failing = failing[np.argsort((end - first)[failing], kind="stable")]
        raw = data.tobytes()
        found = [raw[a:b] for a, b in zip(first[failing].tolist(), end[failing].tolist())]
        many = int(np.searchsorted((end - first)[failing], TOGETHER, "right"))
        exact: list[list[int]] = []
        for i in range(0, many, 4096):
            exact += self.merge_together(found[i : min(i + 4096, many)])
        exact += [self.merge(w) for w in found[many:]]
        own = np.array([len(t) for t in exact], np.int64)
        kept = np.ones(len(sizes), bool)
        kept[failing] = False
        before = ends - sizes
        sizes = sizes.copy()
        sizes[failing] = own
        begin = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        for where, count, source in ((np.flatnonzero(kept), sizes[kept], flat), (failing, own, np.array([x for t in exact for x in t], np.int64))):
            inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            out[np.repeat(begin[where], count) + inside] = source[np.repeat(before[where], count) + inside] if source is flat else source
        return out, sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and how many each has."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        at = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        return self.flat[at], lengths


@lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """The class and a random 64-bit value of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    out[[BETWEEN, ADDED]] = CUT
    return out, columns.mix64((np.arange(0x110000, dtype=U64) + U64(3)) * U64(0x9E3779B97F4A7C15))


def cut_words(cp: np.ndarray) -> np.ndarray:
    """Where the words of a row of code points begin.

    Runs of letters, numbers or others are words, with one space before them; of other white space a run without its
    last character is one and the last, unless it is such a space, another; 's 't 're 've 'm 'll 'd after no space are words.
    """
    kind = classes()[0][cp]
    n = len(cp)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    cut = kind == CUT
    new |= cut
    white = kind == SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = cp[:-1] == 0x20
    starts = new & ~(after_blank & ~white & ~cut)
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~cut[1:]
    starts |= last
    quote = np.flatnonzero((cp == 0x27) & new & ~after_blank)
    quote = quote[quote + 1 < n]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one = cp[quote + 1]
        two = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for chosen, size in ((quote[short], 2), (quote[~short & long], 3)):
            starts[chosen + 1] = False
            end = chosen + size
            end = end[end < n]
            starts[end[kind[end] == LETTER]] = True
    return np.flatnonzero(starts)


class Encoder:
    """A vocabulary and the words that a worker remembers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.special = re.compile("|".join(re.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True))) if vocabulary.added else None
        self.forget()

    def forget(self) -> None:
        self.slot = Table(np.empty(0, np.int64), np.empty(0, np.int64))
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _remember(self, keys: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> None:
        have, n, more = self.slot.used, len(sizes), len(tokens)
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while have + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.count))
        self.flat[self.used : self.used + more] = tokens
        self.first[have : have + n] = self.used + np.cumsum(sizes) - sizes
        self.count[have : have + n] = sizes
        self.used += more
        self.slot.add(keys, np.arange(have, have + n))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and how many each has."""
        if not texts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        added: list[int] = []
        if self.special:
            for k, t in enumerate(texts):
                if self.special.search(t):
                    added += [self.v.added[x] for x in self.special.findall(t)]
                    texts[k] = self.special.sub(chr(ADDED), t)
        joined = "".join(t + chr(BETWEEN) for t in texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = cut_words(cp)
        lengths = np.diff(np.concatenate([starts, [len(cp)]]))
        hashes = (columns.segment_hashes(classes()[1][cp], starts, lengths) >> U64(1)).astype(np.int64)
        if self.slot.used > REMEMBERED:
            self.forget()
        uniq, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self.slot.get(uniq)
        new = np.flatnonzero(slots < 0)
        if len(new):
            s, e = starts[where[new]].tolist(), (starts[where[new]] + lengths[where[new]]).tolist()
            data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
            byte = np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))])
            begin = starts[where[new]]
            first, end = byte[begin], byte[begin + lengths[where[new]]]
            mark = (cp[begin] == BETWEEN) | (cp[begin] == ADDED)
            tokens, sizes = self.v.encode_words(data, first[~mark], end[~mark])
            new = np.concatenate([new[~mark], new[mark]])
            marks = np.full(int(mark.sum()), -1)
            have = self.slot.used
            self._remember(uniq[new], np.concatenate([tokens, marks]), np.concatenate([sizes, np.ones(len(marks), np.int64)]))
            slots[new] = np.arange(have, have + len(new))
        slot = slots[back]
        count = self.count[slot]
        at = np.repeat(self.first[slot] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        ids = self.flat[at].astype(np.int64)
        mark = cp[np.repeat(starts, count)]
        ids[mark == ADDED] = added
        ends = np.flatnonzero(mark == BETWEEN)
        sizes = np.diff(np.concatenate([[-1], ends])) - 1
        return ids[mark != BETWEEN], sizes


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary."""
    if id(shared) not in _encoders:
        _encoders.clear()
        _encoders[id(shared)] = Encoder(shared)
    return _encoders[id(shared)]


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def _apply(df: DataFrame, path: str, id_col: str, value_col: str, fields: list[T.StructField], work) -> DataFrame:
    """mapInArrow over id and value, with the vocabulary (a file of a few MB) sent once to each executor."""
    ship(df.sparkSession)
    vocabulary = df.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *fields])

    def run(batches):
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            ids = batch.column(0)
            data, offsets = columns.buffers(batch.column(1))
            for i, j in columns.slices(offsets):
                part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *work(encoder, *part)], names=schema.names)

    return df.select(id_col, value_col).mapInArrow(run, schema)


def _encode(encoder: Encoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    return encoder.encode([raw[a:b].decode("utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])


def _ids_column(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return columns.large_strings(ids.astype("<u4").view(np.uint8), np.concatenate([[0], np.cumsum(sizes) * 4]), pa.large_binary()).cast(pa.binary())


def _text_column(encoder: Encoder, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    data, lengths = encoder.v.decode(ids)
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
    raw = data.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids: each text's token ids as little-endian unsigned 32-bit integers."""
    return _apply(df, path, id_col, text_col, [T.StructField("ids", T.BinaryType())], lambda e, d, o: [_ids_column(*_encode(e, d, o))])


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and decoded: the text of each row's token ids."""

    def work(e, data, offsets):
        return [_text_column(e, data.view("<u4").astype(np.int64), np.diff(offsets) // 4)]

    return _apply(df, path, id_col, ids_col, [T.StructField("decoded", T.StringType())], work)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids and decoded in one pass: what decode() makes of what encode() makes."""

    def work(e, data, offsets):
        ids, sizes = _encode(e, data, offsets)
        return [pa.array(sizes, pa.int64()), _ids_column(ids, sizes), _text_column(e, ids, sizes)]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return _apply(df, path, id_col, text_col, fields, work)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256."""
    both = round_trip(df, path, id_col, text_col)
    return both.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
