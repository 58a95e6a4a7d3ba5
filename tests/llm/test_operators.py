"""The training-data operators on awkward rows, and against brute force."""

import hashlib
import math
import os
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barspark.llm import bpe, chat, columns, exact_dedup, language, licenses, mixing, ngram_join, passages, queries, sharding, topk
from barspark.llm.components import components
from helpers import same_as_sql

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, copy string, root string, f string, token string"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base = words(300, 1)
    near = list(base)
    near[150] = "changed"
    far = list(base)
    for i in range(0, 300, 12):
        far[i] = f"x{i}"
    other = words(200, 2)
    texts = [
        (1, " ".join(base)), (2, "  ".join(base)), (3, "\t".join(base) + "\n"), (4, " ".join(near)), (5, " ".join(far)), (6, " ".join(other)),
        (7, " ".join(words(60, 3) + base[40:140] + words(60, 4))), (8, None), (9, ""), (10, " \n\t "), (11, "one two"), (12, "one  two"), (13, "one"),
        (14, "Été à l'œuvre: ça va? 中文 <|endoftext|> \U0001f600's"), (15, " ".join(words(30_000, 5, 5_000))), (16, "same"), (16, "same"), (17, "1234 5678 ..."), (None, "no id here"),
    ]
    return [(i, t, "en", "src0" if (i or 0) % 2 else None, 0, "k", "s", "c", "r", "f", "t") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 chat formatting


def test_chat_round_trip(spark):
    hard = ["", "\\", "\\\\", "### ", "</turn>", "\n</turn>\n### user\nx", "<", "#", "####  ###", r"\### Assistant: </turn> ok", "é\U0001f600\\</turn>", "a" * 5000]
    rng = random.Random(0)
    turns = [(c, t, rng.choice(["user", "assistant", "sys\ntem\\"]), rng.choice(hard)) for c in range(40) for t in range(rng.randrange(1, 9))]
    turns += [(100, i % 3, "assistant", f"turn {i}") for i in range(300)] + [(101, 0, None, None), (None, 1, "user", "x"), (101, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(4)
    want = defaultdict(list)
    for c, t, r, x in turns:
        want[c].append((t, r or "", x or ""))
    made = chat.format_conversations(df)
    n = {r["conv_id"]: r["n_turns"] for r in made.select("conv_id", "n_turns").collect()}
    got = chat.read_back(made).collect()
    assert len(got) == len(want) == len(n)
    for r in got:
        w = [(b, c) for _, b, c in sorted(want[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == w and n[r["conv_id"]] == len(w)
        assert r["loss_text"] == "".join(c for b, c in w if b == "assistant")
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


@pytest.mark.parametrize("size", [1, 60, 400, 1 << 20])
def test_chat_slices(size, monkeypatch):
    """Conversations that end in a slice, at its edge, or go on over many."""
    monkeypatch.setattr(columns.slices, "__defaults__", (size,))
    rng = random.Random(1)
    rows = [(c, rng.choice(["user", "assistant"]), rng.choice(["", "é ### x", "abc" * 20])) for c in (None, *range(12)) for _ in range(rng.randrange(1, 9))]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 7]], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["c", "role", "text"]) for i in range(0, len(rows), 7)]
    got = [r for b in chat._format(iter(batches), ["c", "n", "formatted", "a", "b"], "assistant") for r in b.to_pylist()]
    want = defaultdict(list)
    for c, role, text in rows:
        want[c].append((role, text))
    assert [r["c"] for r in got] == list(want)
    for r in got:
        assert chat.parse(r["formatted"]) == want[r["c"]] and r["n"] == len(want[r["c"]])
        assert "".join(chat.unescape(r["formatted"][a:b]) for a, b in zip(r["a"], r["b"])) == "".join(t for role, t in want[r["c"]] if role == "assistant")


# 2 exact dedup


def check_classes(rows, got):
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(rows)
    low = lambda ids: None if None in ids else min(ids)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for t, ids in want.items():
        for i in ids:
            for r in by_id[i]:
                assert r["keep_id"] == low(ids) and r["group_size"] == len(ids)
        assert sum(r["kept"] for i in set(ids) for r in by_id[i]) == 1


@pytest.mark.parametrize("digest", [True, False])
def test_exact_classes(docs, empty, rows, digest):
    got = exact_dedup.exact_classes(docs, digest=digest).collect()
    check_classes(rows, got)
    if digest:
        assert {r["text_sha256"] for r in got} == {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t, *_ in rows}
    assert exact_dedup.exact_classes(empty, digest=digest).collect() == []


def test_exact_without_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", -1)
    check_classes(rows, exact_dedup.exact_classes(docs).collect())
    assert exact_dedup.drop_copies(docs).count() == 15
    monkeypatch.setattr(exact_dedup, "MOST_PLACES", 2)  # most bits are set: more is hashed, and the result stays
    check_classes(rows, exact_dedup.exact_classes(docs).collect())


def test_bitmap_of_shared_prefixes(spark):
    rows = spark.range(20_000).selectExpr("cast(id % 97 as int) as _len", "xxhash64(id) as _head", "id")
    keys = rows.where("id % 5 = 0").select("_len", "_head")
    got = [r["id"] for r in exact_dedup._maybe_shared(rows, keys, 4_000).select("id").collect()]
    assert len(got) == len(set(got)) and set(range(0, 20_000, 5)) <= set(got)
    assert len(got) - 4_000 < 16_000 * 2 / exact_dedup.PLACES


def test_drop_copies(docs, empty, rows):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8, 10, 11, 13, 14, 15, 16, 17]  # 3 ends with white space
    assert exact_dedup.drop_copies(docs.where("doc_id <> 16")).count() == 13  # without the null id and 16
    assert exact_dedup.drop_copies(empty).collect() == []


# 3 sharding


def test_sharding(docs, empty, rows):
    got = sharding.shard_records(docs, 5, bucket_bytes=20_000).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"key"}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 16
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard_records(docs.repartition(7), 5, bucket_bytes=20_000).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    more = {(r["doc_id"]): r["shard"] for r in sharding.shard_records(docs, 6).collect()}
    assert all(more[r["doc_id"]] == r["grown_shard"] for r in got)
    assert sharding.shard_records(empty, 5).collect() == []


@tables
def test_sharding_spreads(spark):
    got = queries.op3_sharding(spark, SF).toPandas()
    crc = {r["doc_id"]: zlib.crc32((r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert (got.text_crc32 == got.doc_id.map(crc)).all() and got.shard.between(0, 39).all()


# 4 BPE


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_rows(docs, empty, rows, tokenizer):
    got = bpe.round_trip(docs, queries.vocabulary_path()).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in got) == want
    both = bpe.decode(bpe.encode(docs, queries.vocabulary_path()), queries.vocabulary_path())
    assert Counter(r["decoded"] for r in both.collect()) == Counter(t or "" for _, t, *_ in rows)
    assert bpe.round_trip(empty, queries.vocabulary_path()).collect() == []


def test_bpe_against_library(tokenizer):
    e = bpe.Encoder(bpe.load(queries.vocabulary_path()))
    rng = random.Random(3)
    letters = "ab 'strevmld  \n\t\r é　ßÄ12٣²…!?<|>'' 's 'll\x1c\x85中文😀 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdehilnorst ") for _ in range(rng.randrange(200))) for _ in range(2000)]
    texts += ["", "<|endoftext|>", " <|endoftext|><|endoftext|>a", "a" * 3000, "ab" * 3000, "'s's 's a's", " " * 50]
    texts += [(a + b).decode("utf-8", "ignore") for a, b in (rng.sample(e.v.bytes, 2) for _ in range(3000))]
    ids, sizes = e.encode(list(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k, x in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == x.ids, texts[k]


def test_pair_check_is_exact():
    v = bpe.load(queries.vocabulary_path())
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50256, 20_000), rng.integers(0, 50256, 20_000)
    good = v.compatible(a, b)
    assert all(good[k] == (v.merge(v.bytes[a[k]] + v.bytes[b[k]]) == [a[k], b[k]]) for k in range(len(a)))
    some = [bytes(rng.integers(97, 123, rng.integers(1, 48)).astype(np.uint8)) for _ in range(3000)]
    assert v.merge_together(some) == [v.merge(w) for w in some]


# 5 licences


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_licenses(spark):
    apache = licenses.TEMPLATES["Apache-2.0"]
    mit = licenses.TEMPLATES["MIT-grant"]
    texts = [(1, "intro\n" + apache + "\nend"), (2, "x\n\n" + mit.replace(" any ", "\nany ") + "\n\ny"), (3, apache.upper()), (4, None), (5, ""), (6, "licensed"), (7, "Licensed under the Apache"), (8, " ".join(words(20_000, 1))), (None, apache), (1, "again")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = licenses.licenses(df)
    found = {(r["doc_id"]): (r["licenses"], r["passages"]) for r in got.collect()}
    want = {i: (set(), set()) for i, _ in texts}
    for i, t in texts:
        passages = [("line", k, x) for k, x in enumerate((t or "").split("\n"))]
        passages += [("block", k, x) for k, x in enumerate(re.split(r"\n[\x20\t\r]*\n", t or "")) if "\n" in x]
        for kind, k, x in passages:
            like = {name for name, body in licenses.TEMPLATES.items() if dice(licenses._pairs(x), licenses._pairs(body)) >= licenses.LEAST_DICE}
            if like:
                want[i] = (want[i][0] | like, want[i][1] | {(kind, k)})
    assert found == {i: (",".join(sorted(names)), len(where)) for i, (names, where) in want.items()}
    assert found[1][0] == found[3][0] == found[None][0] == "Apache-2.0" and found[2][0] == "MIT-grant"
    assert all(found[i] == ("", 0) for i in (4, 5, 6, 8))
    assert got.count() == len(texts) and licenses.licenses(df.limit(0)).collect() == []
    want = {k for k, v in licenses.TEMPLATES.items() if dice(licenses._pairs(apache), licenses._pairs(v)) >= licenses.LEAST_DICE}
    assert want == {"Apache-2.0"}


# 6 top-k


def test_topk(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    vectors[7] = (7, vectors[3][1])
    vectors += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] + [0.0] * 7), (1004, []), (1005, [9.0, 9.0]), (None, [1.0] * 8), (50, vectors[50][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    q = df.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = topk.top_k(q, q.where("vec_id % 50 = 0"), 5, shard=50, part=3)
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by = defaultdict(list)
    for r in got.collect():
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for qi in {i for i, _ in ok if i % 50 == 0}:
        v = dict(ok)[qi]
        want = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != qi)[:5]
        assert sorted(by[qi]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    twice = q.where("vec_id = 0").unionByName(q.where("vec_id = 1").withColumn("vec_id", F.lit(0).cast("long")))
    asked = [(r["rank"], r["vec_id"]) for r in topk.top_k(q, twice, 5).collect()]
    assert len(asked) == 10 and sorted(r for r, _ in asked) == sorted([1, 2, 3, 4, 5] * 2) and not any(v == 0 for _, v in asked)
    assert topk.top_k(q.limit(0), q.limit(0)).collect() == []
    one = q.where("vec_id = 0")
    assert topk.top_k(one, one).collect() == []


def test_topk_leaves_work_out():
    """Where a few terms carry the scores, few pairs are probed in the others; large numbers stay exact."""
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(3000, 64)) * np.where(np.arange(64) < 8, 2000, 3)).astype(np.int64)
    queries = rows[:40]
    for scale in (1, 1 << 12):
        q, x = queries * scale, rows * scale
        qi, ri, score, probed = topk.best(q, np.arange(40), np.arange(3000), x, 5)
        want = q @ x.T
        want[np.arange(40), np.arange(40)] = np.iinfo(np.int64).min // 2
        for k in range(40):
            order = np.lexsort((np.arange(3000), -want[k]))[:5]
            assert ri[qi == k].tolist() == order.tolist() and score[qi == k].tolist() == want[k][order].tolist()
        assert 0 < probed < 0.05 * 40 * 3000


# 7 n-gram Jaccard join


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_classes(pairs, width, num):
    sets = [(i, shingle_set(t, width)) for i, t in pairs]
    uniq = list({s for _, s in sets if s})
    parent = list(range(len(uniq)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(uniq)):
        for b in range(a):
            both = len(uniq[a] & uniq[b])
            if 100 * both >= num * (len(uniq[a]) + len(uniq[b]) - both):
                parent[find(a)] = find(b)
    at = {s: k for k, s in enumerate(uniq)}
    least: dict = {}
    for i, s in sets:
        if s and i is not None:
            c = find(at[s])
            least[c] = min(least.get(c, i), i)
    return Counter((i, len(s), least.get(find(at[s])) if s else i) for i, s in sets)


@pytest.mark.parametrize("block", [512, 3])
def test_near_classes(spark, docs, empty, rows, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rng = random.Random(1)
    base = words(80, 9)
    more = []
    for k in range(60):  # copies with a few changes each, and some that share but a passage
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(80)] = f"y{rng.randrange(1000)}"
        more.append((100 + k, " ".join(t)))
    more += [(200 + k, " ".join(words(40, 50 + k) + base[:30])) for k in range(20)]
    more += [(300, " ".join(base).upper()), (301, "A b"), (302, "a B"), (303, "a b c")]
    pairs = [(i, t) for i, t, *_ in rows] + more
    df = docs.select("doc_id", "text", "f", "root").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumns({"f": F.lit("x"), "root": F.lit("y")}))
    for width, num in ((4, 85), (5, 80)):
        got = ngram_join.near_classes(df, width, num)
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_classes(pairs, width, num)
    assert ngram_join.near_classes(empty).collect() == []
    kept = ngram_join.drop_near(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 5, 6, 7, 8, 9, 10, None}


def test_near_without_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", -1)
    got = ngram_join.near_classes(docs, 4, 85)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_classes([(i, t) for i, t, *_ in rows], 4, 85)


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    root = {r["node"]: r["root"] for r in got}
    nodes = [n for n in parent if any(n in e for e in edges if e[0] != e[1])]
    assert all((root[a] == root[b]) == (find(a) == find(b)) for a in nodes for b in nodes)


# 8 substring dedup


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(100):
        lengths = [int(x) for x in rng.integers(0, 40, rng.integers(1, 6))]
        values, least = rng.integers(1, 1 << 63, sum(lengths)).astype(np.uint64), int(rng.integers(1, 9))
        firsts = np.concatenate([[0], np.cumsum(lengths)])
        got = set(zip(*(x.tolist() for x in passages.windows(values, firsts, least))))
        want = set()
        for d in range(len(lengths)):
            v = values[firsts[d] : firsts[d + 1]]
            for k in range(len(v)):
                a = b = k
                while a > 0 and v[a - 1] > v[k]:
                    a -= 1
                while b + 1 < len(v) and v[b + 1] > v[k]:
                    b += 1
                if b - a + 1 >= least:
                    want.add((d, a, k, b))
        assert got == want


def test_repeated_passages(spark, docs, empty):
    shared, close = words(70, 70, 5000), words(80, 71, 5000)
    changed = list(close)
    changed[40] = "other"
    texts = [(500 + k, " ".join(words(90, 600 + k, 5000) + shared + words(50, 700 + k, 5000))) for k in range(8)]
    texts += [(600, " ".join(words(60, 1, 5000) + close)), (601, " ".join(changed + words(60, 2, 5000))), (602, " ".join(words(300, 3, 5000))), (603, " ".join(words(49, 4, 5000) * 3))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    got = passages.repeated_passages(df).collect()
    seen = {r["doc_id"] for r in got} | {r["partner_id"] for r in got}
    assert {1, 2, 3, 4, 7, *range(500, 508), 600, 601} <= seen
    assert not seen & {6, 11, 12, 13, 14, 15, 602, 603, 8, 9, 10}
    for r in got:
        if 500 <= r["doc_id"] < 508:
            assert abs(r["start_word"] - 90) <= 10 and abs(r["end_word"] - 160) <= 10 and r["jaccard"] == 1.0
    assert passages.repeated_passages(empty).collect() == []


def test_passages_between_outer_documents(spark):
    """Two documents share a passage; those with the least and the greatest ids hold only a part of it, too short to count."""
    texts, pairs = [], set()
    for k in range(20):
        shared = words(50, 5000 + k, 50_000)
        for i in (*range(8), *range(92, 100)):
            texts.append((100 * k + i, " ".join(words(60, 9000 + 100 * k + i, 50_000) + shared[5:44] + words(60, 20_000 + 100 * k + i, 50_000))))
        for i in (40, 50):
            texts.append((100 * k + i, " ".join(words(60, 9000 + 100 * k + i, 50_000) + shared + words(60, 20_000 + 100 * k + i, 50_000))))
        pairs.add((100 * k + 40, 100 * k + 50))
    got = passages.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in got if r["doc_id"] < r["partner_id"]} == pairs


def test_passage_twice_in_a_document(spark):
    """A passage that stands twice in each of two documents is found at both places of either."""
    shared = words(60, 31, 50_000)
    texts = [(i, " ".join(words(70, 40 + i, 50_000) + shared + words(200, 50 + i, 50_000) + shared + words(70, 60 + i, 50_000))) for i in (1, 2)]
    got = passages.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    for i in (1, 2):
        spans = [(r["start_word"], r["end_word"]) for r in got if r["doc_id"] == i]
        assert any(abs(s - 70) <= 10 and abs(e - 130) <= 10 for s, e in spans) and any(abs(s - 330) <= 10 and abs(e - 390) <= 10 for s, e in spans)


def alike_windows(texts, least=46, threshold=0.8):
    """Brute force: of each text, which windows of `least` shingles have an alike one in another text."""
    rows = [[hash(tuple(t.split()[i : i + 5])) for i in range(len(t.split()) - 4)] for t in texts]
    where = defaultdict(list)
    for d, r in enumerate(rows):
        for i, v in enumerate(r):
            where[v].append((d, i))
    out = {}
    for d, r in enumerate(rows):
        others, ok = defaultdict(dict), set()
        for i, v in enumerate(r):
            for e, j in where[v]:
                if e != d:
                    others[e][i] = j
        for places in others.values():
            for i in range(len(r) - least + 1):
                js = [places[p] for p in range(i, i + least) if p in places]
                both = max((sum(j0 <= j < j0 + least for j in js) for j0 in {j for j in js} | {j - least + 1 for j in js}), default=0)
                if both and both / (2 * least - both) >= threshold:
                    ok.add(i)
        if ok:
            out[d] = ok
    return out


def test_passages_against_brute_force(spark):
    """Exact repeats are all found; of passages at the threshold (one or two words of 52 changed) nine in ten at least, and nothing else."""
    rng = random.Random(3)
    texts = []
    for k in range(120):
        passage = words(52, 100 + k, 50_000)
        other = list(passage)
        for _ in range(k % 3):
            other[rng.randrange(52)] = f"edit{rng.randrange(10**6)}"
        for m, p in enumerate((passage, other)):
            texts.append(" ".join(words(60, 1000 + 2 * k + m, 50_000) + p + words(60, 5000 + 2 * k + m, 50_000)))
    line = words(30, 1, 50_000)  # a line that many share is no passage
    texts += [" ".join(words(50, 9000 + k, 50_000) + line + words(50, 9500 + k, 50_000)) for k in range(60)]
    texts += ["The " * 300, "The " * 200 + " ".join(words(60, 2, 50_000)), " ".join(words(100, 3, 50_000)) + " The" * 20]
    want = alike_windows(texts[:300])
    spans = defaultdict(list)
    for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        spans[r["doc_id"]].append((r["start_word"], r["end_word"]))
        spans[r["partner_id"]].append((r["partner_start"], r["partner_end"]))
    found = {d: [any(a <= i and i + 50 <= b for a, b in spans[d]) for i in ok] for d, ok in want.items()}
    exact, near = [f for d, f in found.items() if d // 2 % 3 == 0], [f for d, f in found.items() if d // 2 % 3]
    assert all(map(all, exact)) and len(near) > 40
    assert sum(map(any, near)) >= 0.9 * len(near) and sum(map(sum, near)) >= 0.9 * sum(map(len, near))
    assert {d for d, s in spans.items() if s} <= {*want, 300, 301} and spans[300] and spans[301]


def test_passages_are_all_found_in_families(spark):
    """Every word of every alike window and every component, as by brute force: in a family whose members have two changes each, and of pairs at the threshold."""
    rng = random.Random(8)
    base, texts = words(80, 800, 50_000), []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(80), 2):
            own[at] = f"edit{rng.randrange(25)}"
        texts.append(" ".join(words(30, 40_000 + k, 50_000) + own + words(30, 41_000 + k, 50_000)))
    for k in range(40):
        passage = words(52, 42_000 + k, 50_000)
        other = list(passage)
        other[25] = "edit"
        texts += [" ".join(words(40, 43_000 + 2 * k + m, 50_000) + p + words(40, 44_000 + 2 * k + m, 50_000)) for m, p in enumerate((passage, other))]
    want = {d: {w for i in ok for w in range(i, i + 50)} for d, ok in alike_windows(texts).items()}
    got = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    held = defaultdict(set)
    for r in got:
        held[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert held == want and len(want) > 130
    assert all(r["component_id"] == (0 if r["doc_id"] < 60 else r["doc_id"] // 2 * 2) for r in got if r["doc_id"] >= 60 or r["partner_id"] == 0)


def test_alike_windows_of_two_rows_against_plain_counts():
    """All windows, and how many shingles they share as multisets, in rows that repeat themselves."""
    rng = np.random.default_rng(5)
    for k in range(100):
        least = int(rng.integers(3, 9))
        need = max(2, least - int(rng.integers(0, 3)))
        values = int(rng.integers(2, 30))
        x, y = (rng.integers(0, values, rng.integers(least, 60)) for _ in range(2))
        y = np.concatenate([y, x[3:40], y[:5]]) if k % 2 else y
        a, b = (passages.Line(np.array([[7, 7 + len(t)]]).tobytes(), t.astype(np.uint64).tobytes(), least) for t in (x, y))
        w, j, _ = passages.alike(a, b, least, need)
        counts = lambda t, i: Counter(t[i : i + least].tolist())  # noqa: E731, B023
        others = [counts(y, i) for i in range(len(y) - least + 1)]
        want = [i for i in range(len(x) - least + 1) if any((counts(x, i) & c).total() >= need for c in others)]
        assert (a.place(w) - 7).tolist() == want
        assert all((counts(x, i) & others[o]).total() >= need for i, o in zip(a.place(w) - 7, b.place(j) - 7))


def test_windows_that_repeat_themselves_meet_a_long_row_in_little_memory():
    """The work of windows that hold shingles many times does not grow with how often, nor its memory with the row they meet."""
    rng, least, need = np.random.default_rng(6), 46, 41
    x, y = rng.integers(0, 40, 300), rng.integers(0, 40, 20_000)
    y[12_000:12_100] = x[100:200]
    a, b = (passages.Line(np.array([[0, len(t)]]).tobytes(), t.astype(np.uint64).tobytes(), least) for t in (x, y))
    tracemalloc.start()
    w, j, _ = passages.alike(a, b, least, need)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 64 << 20
    assert set(range(100, 155)) <= set(w.tolist()) and all((Counter(x[i : i + least].tolist()) & Counter(y[o : o + least].tolist())).total() >= need for i, o in zip(w, j))
    p, q = passages._pairs(a, b)
    back = np.argsort(q, kind="stable")
    assert all(np.array_equal(u, v) for u, v in zip(passages.alike(b, a, least, need, (q[back], p[back])), passages.alike(b, a, least, need)))


# 9 language ID


@tables
def test_language(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.held_out(F.col("doc_id"))
    assert {(r["doc_id"], r["h"]) for r in table.select("doc_id", held.alias("h")).collect()} == {(r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in table.select("doc_id").collect()}
    model = language.train(table.where(~held))
    test = language.predict(table.where(held), model, passing=("doc_id", "lang")).toPandas()
    assert (test.lang == test.lang_pred).mean() > 0.97 and test.score.between(0, 1).all()
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert all(odd[i] == ("und", 0.0) for i in (8, 9, 10, 17)) and odd[1][0] != "und"
    assert language.train(empty) == {} and language.predict(empty, {}).collect() == []
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}


def plain_grams(text):
    """Counts of n-grams as tuples of symbols, a symbol at a time."""
    marks, run = [1], False
    for c in text:
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            marks.append(1 + ord(low if len(low) == 1 else c))
            run = True
        elif run:
            marks.append(1)
            run = False
    if marks[-1] != 1:
        marks.append(1)
    found = Counter(tuple(marks[i : i + n]) for n in (1, 2, 3) for i in range(len(marks) - n + 1))
    del found[1,]
    return found


def plain_profile(found):
    return sorted(found, key=lambda g: (-found[g], len(g), g))[: language.TOP]


def test_ngrams_and_profiles_against_plain_counts():
    for text in ("Ab, a", "a", "Été -- à l'œuvre 12 ça", "中文 Текст ελληνικά عربى हिन्दी e\u0301", "x" * 5000, " ".join(words(400, 9))):
        want = plain_grams(text)
        number = lambda g: sum(s << language.BITS * (len(g) - 1 - i) for i, s in enumerate(g))
        assert Counter(language.grams(text).tolist()) == {number(g): n for g, n in want.items()}
        assert language.ranked(language.grams(text)).tolist() == [number(g) for g in plain_profile(want)]
    assert language.grams("12 !") is None and language.grams("") is None and language.grams("\u0301") is None


@tables
def test_language_against_plain_distances(spark, monkeypatch):
    """The query's rows, every one, from counts and distances in plain Python."""
    monkeypatch.setattr(language, "HELD", 500)
    rows = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text", "lang").collect()
    late = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    sums = defaultdict(Counter)
    found = {r["doc_id"]: plain_grams(r["text"] or "") for r in rows}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and not late(r):
            sums[r["lang"]].update(found[r["doc_id"]])
    profiles = {lang: {g: k for k, g in enumerate(plain_profile(c))} for lang, c in sorted(sums.items())}
    want = {}
    for r in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in r["text"] or ""):
            want[r["doc_id"]] = (late(r), "und", 0.0)
            continue
        own = plain_profile(found[r["doc_id"]])
        apart = {lang: sum(abs(p[g] - k) if g in p else language.TOP for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=apart.get)
        want[r["doc_id"]] = (late(r), best, 1 - apart[best] / (language.TOP * len(own)))
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in queries.op9_language_id(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (held, lang, score) in want.items():
        assert got[i][:2] == (held, lang) and abs(got[i][2] - score) < 1e-12


def test_languages_of_other_scripts(spark):
    """Scripts whose letters are all beyond a to z are told apart by their words, and many languages need no wide table."""
    speech = {
        "ru": "в начале было слово и слово было у бога и все через него начало быть".split(),
        "uk": "на початку було слово і слово було в бога і все через нього почало бути".split(),
        "el": "εν αρχη ην ο λογος και ο λογος ην προς τον θεον και παντα δι αυτου εγενετο".split(),
        "zh": "太初有道 道与神同在 道就是神 万物是藉着他造的 生命在他里头".split(),
        "ja": "初めに言があった 言は神と共にあった 言は神であった 万物は言によって成った".split(),
        "hi": "आदि में वचन था और वचन परमेश्वर के साथ था और सब कुछ उसी के द्वारा".split(),
        "ar": "في البدء كان الكلمة والكلمة كان عند الله وكل شيء به كان".split(),
    }
    rng = random.Random(4)
    rows = [(k * 100 + i, " ".join(rng.choices(pool, k=40)), lang) for k, (lang, pool) in enumerate(speech.items()) for i in range(30)]
    rows += [(10_000 + i, "".join(chr(0x4E00 + 37 * i + j) for j in range(20)), f"x{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.where("doc_id % 10 < 5 or doc_id >= 10000"))
    assert len(model) == 207 and max(map(len, model.values())) <= language.TOP
    assert all(r["lang"] == r["lang_pred"] for r in language.predict(df, model, passing=("lang",)).collect())


# 10 mixing


def poisson(mean, u):
    k, term, total = 0, math.exp(-mean), math.exp(-mean)
    while total <= u and k < 10_000:
        k += 1
        term *= mean / k
        total += term
    return k


def test_mixing(spark, docs, empty):
    data = [(i, f"t{i}", "a" if i % 3 else "b") for i in range(3000)] + [(5000, None, None), (None, "x", "c"), (5001, "z", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("copies", F.lit("clash"))
    weights = {"a": 0.2, "b": 0.8}
    for default in (0.0, 0.1):
        got = mixing.mix(df, weights, default=default, seed=5).collect()
        sizes = Counter(s for *_, s in data)
        scale = 1.0 + default * 2
        rate = {s: (weights.get(s, default)) / scale * len(data) / n for s, n in sizes.items()}
        want = Counter()
        for i, t, s in data:
            u = int(hashlib.md5(f"5|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
            n = poisson(rate[s], u) if rate[s] > 0 else 0
            want.update((i, t, c, n) for c in range(n))
        assert Counter((r["doc_id"], r["text"], r["copy"], r["copies"]) for r in got) == want
        keys = [r["shuffle_key"] for r in got]
        assert keys == sorted(keys)
    share = Counter(r["source"] for r in mixing.mix(df, weights, seed=5).collect())
    assert abs(share["b"] / sum(share.values()) - 0.8) < 0.03
    assert mixing.mix(empty, weights).collect() == []
    assert mixing.mix(docs, {"src0": 1.0}).count() > 0


def test_hash_of_words():
    texts = ["a b  c", "", "A\tB\nC", "c b a", "\x0b\x0c", "a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, first = columns.words(data, off)
    assert np.diff(first).tolist() == [3, 0, 3, 3, 0, 1] and h[:3].tolist() == h[3:6].tolist() == h[6:9][::-1].tolist() and h[9] == h[0]
    s, at = columns.shingles(h, first, 2)
    assert np.diff(at).tolist() == [2, 0, 2, 2, 0, 1] and s[0] == s[2] and s[0] != s[4]


# queries


@tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name], spark, SF)


@tables
def test_pipeline_equals_brute_force(spark, tokenizer):
    import corpus_pipeline

    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs = {r["doc_id"]: r for r in table if re.search(r"[^\W\d_]", r["text"] or "")}
    first = {}
    for i in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i]["text"]), i)
    left = sorted(first.values())
    near = {i: c for i, _, c in brute_classes([(i, docs[i]["text"]) for i in left], 5, 80)}
    left = [i for i in left if near[i] == i]
    sizes = Counter(docs[i]["source"] for i in left)
    scale = sum(queries.WEIGHTS[s] for s in sizes)
    want = Counter()
    for i in left:
        s = docs[i]["source"]
        u = int(hashlib.md5(f"{queries.MIX_SEED}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        ids = tokenizer.encode(docs[i]["text"], add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes()] += poisson(queries.WEIGHTS[s] / scale * len(left) / sizes[s], u)
    assert got == +want
