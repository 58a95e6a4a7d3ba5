"""The pipeline's stages, and operators that return whole rows, on awkward tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barspark.llm import exact_dedup, ngram_join, sharding
from test_operators import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, copy string, copies long, shuffle_key string, size string, tags map<string,string>"


@pytest.fixture(scope="module")
def odd(spark):
    base, near = words(120, 1), words(120, 1)
    near[60] = "changed"
    texts = [(1, " ".join(base)), (2, " ".join(near)), (3, " \t".join(base)), (4, None), (5, ""), (6, "  "), (7, "7 8 9"), (8, " ".join(words(20_000, 2, 9_000))), (9, "one two"), (9, "one two"), (9, " ".join(words(50, 3))), (10, " ".join(base)), (10, " ".join(words(40, 4))), (None, "no id"), (None, "no id"), (None, " ".join(base)), (11, "no source")]
    rows = [(i, t, "en", [f"src{k % 3}", "elsewhere", None][k % 3], 0, f"s{k}", "p", f"c{k}", k, "x", "z", {"k": str(k)}) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def text_of(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, odd, name, stage):
    got = stage(spark, odd, "")
    given = {(r["doc_id"], r["score"]): r for r in odd.collect()}
    rows = got.collect()
    if name != "bpe":
        assert got.columns == odd.columns
        assert all(r == given[r["doc_id"], r["score"]] for r in rows)  # own columns keep their values
    have = text_of(rows) if name != "bpe" else None
    if name == "language_id":
        assert have == Counter({k: n for k, n in text_of(odd.collect()).items() if k[0] not in (4, 5, 6, 7)})
    if name == "exact_dedup":
        assert len(have) == sum(have.values()) == len({exact_key(t) for _, t in text_of(odd.collect())})
    if name == "mix_sources":
        assert {r["source"] for r in odd.collect()} == {"src0", "elsewhere", None} and {r["source"] for r in rows} == {"src0", "elsewhere", None}
    if name == "bpe":
        assert all(r["round_trip"] for r in rows) and Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), "").collect() == []


def test_exact_copies_by_row(odd):
    got = text_of(exact_dedup.drop_copies(odd).collect())
    base = " ".join(words(120, 1))
    want = text_of(odd.collect())
    norm = defaultdict(list)
    for i, t in want:
        norm[exact_key(t)].append((i, t))
    assert len(got) == sum(got.values()) == len(norm)
    assert got[None, base] == 1  # null ids are the smallest
    assert not any(i in (1, 3) for i, _ in got) and got[10, " ".join(words(40, 4))] == 1 and got[9, "one two"] == 1 and got[9, " ".join(words(50, 3))] == 1


def exact_key(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_near_copies_by_row(spark, odd):
    got = text_of(ngram_join.drop_near(odd).collect())
    base = " ".join(words(120, 1))
    assert got[1, base] == 1 and not any(t == base and i != 1 for i, t in got) and (2, None) not in got and not any(i in (2, 3) for i, _ in got)
    assert got[9, "one two"] == 1 and got[9, " ".join(words(50, 3))] == 1 and got[10, " ".join(words(40, 4))] == 1 and got[None, "no id"] == 1
    assert all((i, t) in got for i, t in ((4, None), (5, ""), (6, "  "), (7, "7 8 9"), (11, "no source")))
    few = spark.createDataFrame([(1, words_text := " ".join(words(60, 7))), (2, words_text), (2, "other")], "doc_id long, text string")
    assert text_of(ngram_join.drop_near(few).collect()) == Counter([(1, words_text), (2, "other")])


def test_shards_of_one_id(spark, odd):
    rows = [(None, f"text {k} " * 50, {"a": str(k)}) for k in range(400)] + [(None, "again", {"a": "b"})] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,string>").repartition(4)
    placed = sharding.shard_records(df, 4, bucket_bytes=20_000)
    got = placed.collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(450))
    assert Counter((r["text"], r["tags"]["a"]) for r in got) == Counter((t, m["a"]) for _, t, m in rows)
    again = sharding.shard_records(df.repartition(9), 4, bucket_bytes=20_000).collect()
    assert sorted((r["slot"], r["text"]) for r in got) == sorted((r["slot"], r["text"]) for r in again)
    assert [r["text"] for r in sorted(got, key=lambda r: r["slot"])] != [t for _, t, _ in rows]
    assert sharding.shard_records(odd, 3).count() == odd.count()


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), 3, file_bytes=1)
    for k in range(3):
        part = spark.read.parquet(str(tmp_path / f"s/shard={k}")) if (tmp_path / f"s/shard={k}").exists() else None
        if part is not None:
            slots = [r["slot"] for r in part.withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id()).orderBy("f", "i").collect()]
            assert slots == list(range(len(slots)))
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()
