"""Clustering, hard-negative mining and packing on awkward rows, and against brute force."""

import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from barspark.llm import clustering, negatives, packing, queries
from helpers import same_as_sql

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, n int, cluster string, distance int, copies int, kth string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "v", 2, "c", 3, 4, "k") for i, v, label in rows], VECTORS).repartition(4)


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, dims))
    return [(middles[rng.integers(5)] + spread * rng.normal(size=dims)).astype(np.float32).tolist() for _ in range(n)]


def floors(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


# 11 centroid clustering


def lloyd(rows, k, rounds, scale):
    """Plain Lloyd over all rows (id, quantised vector)."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(r[1]) for r in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in rows:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in rows]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    key = lambda r: tuple((x is None, x or 0) for x in r[:3])
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found], key=key)


def test_clustering_equals_plain_lloyd_on_awkward_rows(spark):
    good = [(i, v, 0) for i, v in enumerate(vectors(150, 4, 3))]
    hot = [(1000 + i, [0.5, -0.25, 0.0, 1.0], 0) for i in range(80)]
    rows = good + hot + [good[7], good[7], (7, [9.0, 9.0, 9.0, 9.0], None), (None, [0.1, 0.2, 0.3, 0.4], 1)]
    bad = [(2000, None, 1), (2001, [1.0, None, 1.0, 1.0], 1), (2002, [1.0, NAN, 1.0, 1.0], 1), (2003, [INF, 1.0, 1.0, 1.0], 1), (2004, [1.0] * 3, 1), (2005, [1.0] * 5, 1), (2006, [], 1)]
    got = clustering.cluster(frame(spark, rows + bad), k=5, rounds=3, dims=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: tuple((x is None, x or 0) for x in r[:3])
    assert sorted((tuple(r) for r in got.collect()), key=key) == lloyd([(i, floors(v, 64)) for i, v, _ in rows], 5, 3, 64)


def test_clustering_of_few_or_no_rows_and_far_components(spark):
    assert clustering.cluster(frame(spark, []), dims=4).collect() == []
    few = [(1, [0.0, 0.0], 0), (2, [1.0, 1.0], 0)]
    assert sorted((r.vec_id, r.distance) for r in clustering.cluster(frame(spark, few), k=16, dims=2).collect()) == [(1, 0), (2, 0)]
    far = [(1, [3e38, -3e38], 0), (2, [-3e38, 3e38], 0), (3, [3e38, -3e38], 0)]
    got = {r.vec_id: r for r in clustering.cluster(frame(spark, far), k=1, rounds=2, dims=2).collect()}
    assert len(got) == 3 and all(0 <= r.distance <= r.cluster_inertia <= r.inertia for r in got.values())


def test_partial_sums_of_ties_go_to_the_smaller_number():
    own, d = clustering.nearest(np.array([[0, 0], [4, 0], [2, 0]]), np.array([[0, 0], [4, 0]]))
    assert own.tolist() == [0, 1, 0] and d.tolist() == [0, 0, 4]
    big = np.array([[1 << 27, -(1 << 27)] * 32])
    assert clustering.nearest(big, -big)[1][0] == 64 * (1 << 28) ** 2  # beyond 2^53, exact


@tables
def test_op11_equals_sql(spark):
    same_as_sql(queries.op11_clustering, queries.oracle_sql()["op11_clustering"], spark, SF)


# 12 hard-negative mining


def mined(rows, anchor, positives, negatives_, low, high):
    """By looking at all rows for each anchor."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in rows if anchor(i)}:
        scored = sorted((-dot(v, x), j, m) for j, m, x in rows if j != i)
        for s, j in [(-s, j) for s, j, m in scored if m == label][:positives]:
            fit = [(-t, n) for t, n, m in scored if m != label and low * s <= 100 * -t <= high * s][:negatives_]
            out += [(i, j, k + 1, n, s, t) for k, (t, n) in enumerate(fit)]
    return sorted(out)


def test_mining_equals_brute_force_on_awkward_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, v, rng.randrange(3)) for i, v in enumerate(vectors(260, 6, 8, 0.4))]
    hot = [(1000 + i, [0.5, 0.25, 0.0, 1.0, 0.5, 0.5], i % 2) for i in range(90)]  # a third of the rows
    rows += hot + [rows[20], rows[20], (20, [1.0] * 6, 1), (40, [0.5, 0.5], 2), (300, [], 1), *[(77, [0.5, 0.25, 0.0, 1.0, 0.5, 0.5], 2)] * 30]
    bad = [(2000, None, 1), (2020, [1.0, None], 1), (2040, [NAN, 1.0], 1), (2060, [INF, 1.0], 1), (2080, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    want = mined([(i, label, floors(v, 256)) for i, v, label in rows], lambda i: i % 20 == 0, 5, 10, 30, 90)
    from pyspark.sql import functions as F

    df = frame(spark, rows + bad).withColumn("v", clustering.bounded(F.col("embedding"), 256))
    monkeypatch.setattr(negatives, "PIECE", 32)
    monkeypatch.setattr(negatives, "SLICE", 4)
    monkeypatch.setattr(negatives, "FIRST", 1)
    monkeypatch.setattr(negatives, "GROW", 2)  # many rounds, pieces and slices
    got = negatives.mine(df, F.col("vec_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_mining_an_empty_table(spark):
    from pyspark.sql import functions as F

    df = frame(spark, []).withColumn("v", clustering.bounded(F.col("embedding"), 256))
    assert negatives.mine(df, F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_skip_lists_and_lose_nothing():
    rng = np.random.default_rng(2)
    middles = rng.integers(-2000, 2000, (20, 8))
    own = rng.integers(20, size=4000)
    x = middles[own] + rng.integers(-30, 30, (4000, 8))
    radii = np.array([np.sqrt(((x[own == c] - middles[c]) ** 2).sum(1).max()) for c in range(20)])
    q = middles[rng.integers(20, size=50)] + rng.integers(-30, 30, (50, 8))
    score = q @ x.T
    low, high = np.partition(score, -40, 1)[:, -40:-39], np.partition(score, -10, 1)[:, -10:-9]
    need, place = negatives.needed(q, low, high, middles, radii)
    holds = np.zeros(need.shape, bool)
    for c in range(20):
        holds[:, c] = ((score[:, own == c] >= low) & (score[:, own == c] <= high)).any(1)
    assert (need | ~holds).all()  # every list with an admitted row is visited
    assert need.mean() < 0.3  # and most others are not
    assert all(sorted(p) == list(range(20)) for p in place.tolist())


@tables
def test_op12_equals_sql(spark):
    same_as_sql(queries.op12_hard_negatives, queries.oracle_sql()["op12_hard_negatives"], spark, SF)


# 13 packing


def test_hilbert_steps_to_a_neighbour():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_cuts():
    assert packing.cuts(0, 1024, True).tolist() == []
    assert packing.cuts(2048, 1024, True).tolist() == [1024, 2048]
    assert packing.cuts(1024 + 700, 1024, False).tolist() == [1024]
    assert packing.cuts(1024 + 700, 1024, True).tolist() == [1024, 1536, 1664, 1696, 1712, 1720, 1724]


def test_documents_alike_lie_near_on_the_curve(spark):
    rng = random.Random(9)
    topics = [[f"t{k}w{j}" for j in range(60)] for k in range(6)]
    texts = [(k, " ".join(rng.choice(topics[k]) for _ in range(400))) for k in range(6) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string").repartition(3)
    order = packing.encoded(df, queries.vocabulary_path()).where("start = 0").orderBy("key").select("doc_id").collect()
    topic = [texts[r.doc_id][0] for r in order]
    assert np.mean([a == b for a, b in zip(topic, topic[1:])]) > 0.7  # by chance: 0.16


def check_pieces(rows, texts, length):
    """Sequences without gaps, little padding, and every document's ids as the tokenizers library makes them, each in one piece."""
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    tok.no_padding()
    tok.no_truncation()
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at == length or at < length and at & (at - 1) == 0  # no padding at all
    docs = defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    assert docs.keys() == want.keys()
    for i, several in want.items():
        if len({x.tobytes() for x in several}) == 1 and len(several) == 1:
            ids, at = several[0], 0
            for start, n, crc, total in sorted(docs[i]):
                assert start == at and total == len(ids) and zlib.crc32(ids[at : at + n].tobytes()) == crc
                at += n
            assert at == len(ids)
        else:
            assert sum(p[1] for p in docs[i]) == sum(len(x) for x in several)
            assert sorted({p[3] for p in docs[i]}) == sorted({len(x) for x in several})


def test_packing_awkward_rows(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    long_ = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    texts = [(1, None), (2, ""), (3, "x"), (4, long_), (5, "same words here"), (5, "same words here"), (6, " \n\t"), (None, "no id"), (7, "Été 中文 <|endoftext|> \U0001f600")] + [(100 + i, "hot copy " * 40) for i in range(60)] + [(300 + i, " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 300)))) for i in range(40)]
    df = spark.createDataFrame([(i, t, "s", 1, 2, "k") for i, t in texts], "doc_id long, text string, start string, length int, offset int, key string").repartition(5)
    got = packing.pack(df, queries.vocabulary_path(), range_tokens=9_000)
    rows = got.withColumn("ids_crc32", F.crc32("ids")).collect()
    assert len({r.sequence_id // packing.TASK for r in rows}) > 3
    check_pieces(rows, texts, 1024)
    whole = packing.sequences(got).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in rows) and all(len(r.ids) == 4 * sum(p.length for p in r.documents) for r in whole)
    assert packing.pack(df.limit(0), queries.vocabulary_path()).collect() == []


@tables
def test_op13_equals_the_tokenizers_library(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(queries.op13_packing(spark, SF).collect(), texts, 1024)


# Earlier queries against what their contracts say


@tables
def test_op3_at_40_shards_keeps_its_law(spark):
    from barspark.llm import sharding

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    more = sharding.shard_records(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), 41)
    grown = {r.doc_id: r.shard for r in more.select("doc_id", "shard").collect()}
    slots = defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.law, r.size, r.text_crc32) == ("key", len(raw) + 16, zlib.crc32(raw))
        assert r.grown_shard == grown[r.doc_id] and r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@tables
def test_op4_digests_are_those_of_the_tokenizers_library(spark):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    tok.no_padding()
    tok.no_truncation()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op4_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tok.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
