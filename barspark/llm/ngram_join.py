"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the classes that the links form.

Prefix filtering under several global token orders. If two sets link, then under any order of all
tokens each must hold one of the other's tokens among its first n - ceil(t * n) + 1, and c of
them among c - 1 more. The orders here are

1. the token's hash over the whole corpus: a set stays if enough of its first tokens occur in
   another set's first tokens;
2. document frequency among the sets that stayed, rare tokens first: a token of one set alone
   uses up prefix and matches nothing, so text that shares only a common passage leaves here;
   sets that share a prefix token form candidate groups;
3. and 4. the hash upwards and downwards within a group: a pair must share prefix tokens under
   all of these orders and have fitting sizes before its overlap is counted.

Equal sets are one set from the start (their fingerprint), so copies are never paired. A
candidate group is verified in blocks of bounded size; a block reports a spanning forest of the
links it found, not its pairs, and the forests' connected components are the classes. No link is
lost: every pair that passes the orders is counted in some block, with no cap on partners.

Tokens, sets and words are known by 64-bit hashes. Defined cases: null and empty texts, and
texts of white space, have no shingle and link with nothing; a text of fewer words than a
shingle has its whole sequence as the one; rows with equal ids or texts are rows of their own;
null ids count as larger than all others (a class of nothing else has a null component); an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import columns
from .columns import U64
from .components import components
from .support import BROADCAST_ROWS, fresh, saved

#: Documents and shingles that a block of a candidate group holds, about; small groups share a task up to so many shingles.
BLOCK_SETS, BLOCK_TOKENS = 512, 300_000
#: One more shared token is asked for in the first order for so many tokens of a set.
EVERY = 12
#: Columns of the incidence matrices that are multiplied at once.
WIDE = 4096


def least_kept(n, num: int, den: int):
    """ceil(n * num / den): the least overlap of a set of n tokens with any set that it links with."""
    return -(-n * num // den)


def document_sets(column, width: int):
    """The sorted distinct shingle hashes of each text, one by one."""
    data, offsets = columns.buffers(column)
    for i, j in columns.slices(offsets):
        words, firsts = columns.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        tokens, at = columns.shingles(words, firsts, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.unique(tokens[a:b])


def fingerprint(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(columns.segment_hashes(tokens, np.zeros(1, np.int64), np.array([len(tokens)])).view(np.int64)[0]) if len(tokens) else 0


def _summaries(width: int):
    def run(batches):
        for batch in batches:
            sets = [(len(s), fingerprint(s)) for s in document_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([f for _, f in sets], pa.int64())], names=["id", "n", "f"])

    return run


def _first_tokens(width: int, num: int, den: int):
    """The first tokens by hash of every set, as (token, f)."""

    def run(batches):
        for batch in batches:
            tokens, sets, held = [], [], 0
            for s in document_sets(batch.column(0), width):
                n = len(s)
                if not n:
                    continue
                take = n - least_kept(n, num, den) + max(1, n // EVERY)
                tokens.append(s[:take])
                sets.append((fingerprint(s), min(take, n)))
                held += take
                if held > 200_000:
                    yield _pairs(tokens, sets)
                    tokens, sets, held = [], [], 0
            if sets:
                yield _pairs(tokens, sets)

    return run


def _pairs(tokens, sets):
    f = np.repeat(np.array([x for x, _ in sets], np.int64), np.array([k for _, k in sets]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(f)], names=["token", "f"])


def _whole_sets(width: int):
    def run(batches):
        for batch in batches:
            rows = []
            for s in document_sets(batch.column(0), width):
                if len(s):
                    rows.append((fingerprint(s), len(s), s.tobytes()))
                if len(rows) == 256:
                    yield _sets(rows)
                    rows = []
            if rows:
                yield _sets(rows)

    return run


def _sets(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["f", "n", "tokens"])


def _tokens_of_sets(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sizes = part.column(1).to_numpy()
            flat = np.concatenate([np.frombuffer(b, np.int64) for b in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes))], names=["token", "f", "n"])


def incidence(doc: np.ndarray, code: np.ndarray, docs: int) -> np.ndarray:
    """How many codes each two documents have in common, by products of incidence matrices."""
    out = np.zeros((docs, docs), np.float32)
    uniq, code = np.unique(code, return_inverse=True)
    for a in range(0, len(uniq), WIDE):
        here = (code >= a) & (code < a + WIDE)
        m = np.zeros((docs, min(WIDE, len(uniq) - a)), np.float32)
        m[doc[here], code[here] - a] = 1
        out += m @ m.T
    return out


def links(sets: list[np.ndarray], num: int, den: int, across: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of a block link, as pairs of places. across: pairs are asked for between unlike values only."""
    docs = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(docs), n)
    uniq, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    doc, code = doc[shared], code[shared]
    known = np.bincount(doc, minlength=docs)
    room = n - least_kept(n, num, den) + 1 - (n - known)  # of the prefix, after the tokens that no other set has
    fits = den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :])
    fits &= np.tri(docs, k=-1, dtype=bool).T
    if across is not None:
        fits &= across[:, None] != across[None, :]
    for by in (times[code], code, -code):
        if not fits.any():
            return np.empty((0, 2), np.int64)
        order = np.lexsort((code, by, doc))
        first = np.cumsum(known) - known
        inside = np.arange(len(order)) - np.repeat(first, known)
        keep = order[inside < np.repeat(room, known)]
        fits &= incidence(doc[keep], code[keep], docs) > 0
    pairs = np.argwhere(fits)
    if len(pairs) <= 4 * docs:
        own = [code[a : a + k] for a, k in zip(np.cumsum(known) - known, known)]
        both = np.array([len(np.intersect1d(own[i], own[j], assume_unique=True)) for i, j in pairs], np.int64)
    else:
        both = np.rint(incidence(doc, code, docs)[pairs[:, 0], pairs[:, 1]]).astype(np.int64)
    return pairs[den * both >= num * (n[pairs[:, 0]] + n[pairs[:, 1]] - both)] if len(pairs) else pairs


def forest(pairs: np.ndarray, docs: int) -> np.ndarray:
    """Pairs (place, least place of its component) that connect what the given pairs do."""
    label = np.arange(docs)
    while len(pairs):
        least = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], least)
        np.minimum.at(new, pairs[:, 1], least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(docs))
    return np.stack([moved, label[moved]], 1)


def _verify(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("root", "ascending"), ("f", "ascending")])
        root, f, part = (table.column(c).to_numpy() for c in ("root", "f", "part"))
        column = table.column("tokens")
        ends = np.concatenate([np.flatnonzero(root[1:] != root[:-1]) + 1, [len(root)]]).tolist()
        a, out = 0, []
        for b in ends:
            sets = [np.frombuffer(x, U64) for x in column.slice(a, b - a).to_pylist()]
            sides = part[a:b]
            if b - a > 1:
                found = forest(links(sets, num, den, sides if (sides != sides[0]).any() else None), b - a)
                out.append(f[a:b][found])
            a = b
        edges = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return run


def near_classes(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, n_shingles, component_id (the smallest id that links reach). Sets link when overlap * den >= union * num."""
    out = _classed(df, width, num, den, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def _classed(df: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, f (the set's fingerprint), class and least (its smallest id) of every row; without a shingle a row is its own class."""
    ship(df.sparkSession)
    text = df.select(text_col)
    sets = saved(df.select(F.col(id_col).cast("long"), text_col).mapInArrow(_summaries(width), "id long, n long, f long"), "ngram-sets")
    distinct = sets.where("n > 0").groupBy("f", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))

    # Order 1: hash. Tokens among the first of two unlike sets, and the sets that have enough of them.
    first = text.mapInArrow(_first_tokens(width, num, den), "token long, f long")
    common = first.groupBy("token").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo < hi").select("token")
    found = first.join(saved(common, "ngram-common"), "token").groupBy("f").agg(F.count("*").alias("hits"))
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * num / F.lit(float(den))) / EVERY) - 1)
    stay = saved(distinct.join(found, "f").where(F.col("hits") >= need * F.col("copies")).select("f", "n", "rep"), "ngram-stay")

    # The sets that stayed, read again; one row each.
    few = stay.count() <= BROADCAST_ROWS
    reps = stay.select("rep").distinct()
    again = df.select(F.col(id_col).cast("long").alias("id"), text_col).join(F.broadcast(reps) if few else reps, F.col("id").eqNullSafe(F.col("rep")), "left_semi").select(text_col)
    whole = again.mapInArrow(_whole_sets(width), "f long, n long, tokens binary").join(F.broadcast(stay.select("f")) if few else stay.select("f"), "f", "left_semi")
    whole = saved(whole.dropDuplicates(["f"]), "ngram-whole")

    # Order 2: document frequency. Prefix tokens of two sets or more make candidate groups.
    tokens = whole.mapInArrow(_tokens_of_sets, "token long, f long, n long")
    often = saved(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "ngram-often")
    ranked = tokens.join(often, "token").groupBy("f", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    room = F.col("n") - F.ceil(F.col("n") * num / F.lit(float(den))) + 2 - (F.col("n") - F.size("t"))  # one to spare for rounding
    prefix = saved(ranked.select("f", F.explode(F.slice("t", 1, F.greatest(room, F.lit(0)).cast("int"))).alias("t")).select("f", "t.token"), "ngram-prefix")
    hub = saved(prefix.groupBy("token").agg(F.min("f").alias("hub"), F.count("*").alias("k")).where("k > 1").select("token", "hub"), "ngram-hubs")
    groups = components(prefix.join(hub, "token").where("f <> hub").select("f", "hub").distinct(), "f", "hub")

    # Blocks: small groups share tasks, large ones are split and each pair of parts meets in one task.
    grouped = saved(whole.join(groups.select(F.col("node").alias("f"), "root"), "f"), "ngram-grouped")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    parts = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("size") / BLOCK_TOKENS), F.lit(1)).cast("int")
    sizes = saved(sizes.select("root", parts.alias("parts"), "size"), "ngram-groups")
    tasks = max(1, -(-(sizes.where("parts = 1").agg(F.sum("size").alias("s")).first()["s"] or 0) // (4 * BLOCK_TOKENS)))
    placed = grouped.join(sizes.drop("size"), "root")
    small = placed.where("parts = 1").select("root", "f", "tokens", F.lit(0).alias("part"), F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).cast("long").alias("g"))
    mine = F.pmod(F.xxhash64("f"), F.col("parts")).cast("long")
    large = placed.where("parts > 1").withColumn("part", mine).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    large = large.select("root", "f", "tokens", F.col("part").cast("int"), F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), F.col("root").alias("g"))
    edges = small.unionByName(large).groupBy("g", "i", "j").applyInArrow(_verify(num, den), "a long, b long")
    roots = components(edges)

    classed = saved(sets.where("n > 0").join(roots.select(F.col("node").alias("f"), "root"), "f", "left").select("id", "n", "f", F.coalesce("root", "f").alias("class")), "ngram-classed")
    least = saved(classed.groupBy("class").agg(F.min("id").alias("least")), "ngram-least")
    linked = classed.join(least, "class").select("id", "n", "f", "class", "least")
    return linked.unionByName(sets.where("n = 0").select("id", "n", "f", F.lit(None).cast("long").alias("class"), F.col("id").alias("least")))


def drop_near(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows and columns with one row of each class, of the smallest id (null ids last); rows without a shingle stay.

    An id of one row is decided by the id; rows of ids that repeat, or are null, by id and set, and of several such rows
    in one class with its smallest id the one with the least text hash stays.
    """
    classed = saved(_classed(df, width, num, den, id_col, text_col), "ngram-decided")
    of, f, row = fresh(df, "of", "f", "row")
    gone = classed.where("class is not null and not (id <=> least)").select(F.col("id").alias(of)).distinct()
    again = saved(classed.groupBy("id").agg(F.count("*").alias("k"), F.max(F.col("class").isNotNull()).alias("any")).where("(k > 1 or id is null) and any").select(F.col("id").alias(of)), "ngram-again")
    key = F.col(id_col).cast("long")
    unique = again.isEmpty()
    gone = saved(gone if unique else gone.unionByName(again).distinct(), "ngram-gone")
    kept = df.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key.eqNullSafe(gone[of]), "left_anti")
    if unique:
        return kept
    rows = df.join(again, key.eqNullSafe(again[of]), "left_semi")
    rows = rows.mapInArrow(_with_fingerprint(width, df.columns.index(text_col), [*df.columns, f]), T.StructType([*df.schema.fields, T.StructField(f, T.LongType())]))
    firsts = classed.where("class is not null and id <=> least").select(F.col("id").alias(of), F.col("f").alias("_set"), "class").distinct()
    none = rows.where(F.col(f).isNull()).drop(f)
    one = rows.join(firsts, key.eqNullSafe(firsts[of]) & (rows[f] == firsts["_set"])).groupBy("class").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(F.xxhash64(F.col(text_col)), F.col(f))).alias(row))
    return kept.unionByName(none).unionByName(one.select(f"{row}.*"))


def _with_fingerprint(width: int, at: int, names: list[str]):
    """The batch's columns and each text's fingerprint; null without a shingle."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(s) if len(s) else None for s in document_sets(batch.column(at), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=names)

    return run
