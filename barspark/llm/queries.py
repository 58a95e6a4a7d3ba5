"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, exact_dedup, language, licenses, mixing, negatives, ngram_join, packing, passages, sharding, topk
from .support import table

#: Half of the mixture from the first six sources, half from the others of the twenty named.
WEIGHTS = {f"src{i}": (0.5 / 6 if i < 6 else 0.5 / 14) for i in range(20)}
#: The weight of each source that they do not name, null included.
OTHER_WEIGHT = 0.5 / 14
MIX_SEED = 7
#: A vocabulary file of the installed package of public tokenizers.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Both turns of the conversation that op1 adds, numbered -7.
HARD_TURN = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TURN), (-7, 1, "assistant", HARD_TURN)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(turns.unionByName(hard)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"), digest=True)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_records(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"), width=4, num=85)


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumn("jaccard", F.round("jaccard", 9))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    found = language.predict(docs, language.train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, WEIGHTS, default=OTHER_WEIGHT, seed=MIX_SEED)
    return mixed.select("doc_id", "source", F.col("copy").cast("long").alias("copy"), F.col("copies").cast("long").alias("copies"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), clustering.bounded(F.col("embedding"), 256).alias("v"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), length=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP1 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD_TURN}' UNION ALL SELECT -7, 1, 'assistant', '{HARD_TURN}'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ') AS safe FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || chr(10) || safe || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
OP2 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def _op5() -> str:
    rows = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    norm = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    grams = "list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
    return rf"""
WITH templates(license, body) AS (VALUES {rows}),
t AS (SELECT license, {grams} AS b FROM (SELECT license, string_split({norm.format("body")}, ' ') AS w FROM templates)),
tg AS (SELECT license, len(b) AS size, unnest(b) AS g FROM t),
lines AS (SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
blocks AS (SELECT doc_id, 'block' AS kind, unnest(string_split_regex(text, '\n[\x20\t\r]*\n')) AS x, generate_subscripts(string_split_regex(text, '\n[\x20\t\r]*\n'), 1) AS pos FROM documents),
u AS (SELECT doc_id, kind, pos, string_split({norm.format("x")}, ' ') AS w FROM (SELECT * FROM lines UNION ALL SELECT * FROM blocks WHERE contains(x, chr(10)))),
g AS (SELECT doc_id, kind, pos, {grams} AS b FROM u),
x AS (SELECT doc_id, kind, pos, len(b) AS n, unnest(b) AS g FROM g),
d AS (SELECT doc_id, kind, pos, license, 2.0 * count(*) / (any_value(n) + any_value(size)) AS dice FROM x JOIN tg USING (g) GROUP BY ALL HAVING 2.0 * count(*) / (any_value(n) + any_value(size)) >= {licenses.LEAST_DICE}),
f AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, count(DISTINCT (kind, pos)) AS passages, max(dice) AS best_dice FROM d GROUP BY doc_id)
SELECT documents.doc_id, coalesce(licenses, '') AS licenses, coalesce(passages, 0) AS passages, round(coalesce(best_dice, 0.0), 9)::DOUBLE AS best_dice
FROM documents LEFT JOIN f USING (doc_id)
"""
OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, least(len(q.v), len(c.v)) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
OP12 = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT min(row) AS a, vec_id AS anchor_id, label, v FROM v WHERE vec_id % 100 = 0 GROUP BY ALL),
s AS MATERIALIZED (SELECT a, anchor_id, a.label = v.label AS same, vec_id, row, coalesce(list_sum([a.v[i] * v.v[i] FOR i IN range(1, least(len(a.v), len(v.v)) + 1)]), 0)::BIGINT AS score FROM a JOIN v ON vec_id <> anchor_id),
p AS (SELECT a, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, row) AS place FROM s WHERE same),
n AS (SELECT s.anchor_id, positive_id, row_number() OVER (PARTITION BY a, place ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM s JOIN p USING (a) WHERE place <= 5 AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""


def _op10() -> str:
    rows = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in WEIGHTS.items())
    return rf"""
WITH RECURSIVE wanted(source, w) AS (VALUES {rows}),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rate AS (SELECT n.source, coalesce(w, {OTHER_WEIGHT!r}::DOUBLE) / sum(coalesce(w, {OTHER_WEIGHT!r}::DOUBLE)) OVER () * (SELECT count(*) FROM documents) / n AS mean FROM n LEFT JOIN wanted ON n.source = wanted.source),
cdf(source, mean, k, term, below, total) AS (
  SELECT source, mean, 0, exp(-mean), 0.0::DOUBLE, exp(-mean) FROM rate
  UNION ALL SELECT source, mean, k + 1, term * (mean / (k + 1)), total, total + term * (mean / (k + 1)) FROM cdf WHERE k < mean + 12 * sqrt(mean) + 40),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
c AS (SELECT doc_id, u.source, text, k AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source WHERE u >= below AND u < total AND k > 0)
SELECT doc_id, source, unnest(range(copies::BIGINT)) AS "copy", copies::BIGINT AS copies, md5(coalesce(text, '')) AS text_md5 FROM c
"""


def _op11(k: int = 16, rounds: int = 3) -> str:
    ctes = []
    for r in range(rounds + 1):  # round `rounds` only assigns
        ctes.append(f"d{r} AS MATERIALIZED (SELECT row, c, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{r} USING (place) GROUP BY row, c)")
        ctes.append(f"a{r} AS MATERIALIZED (SELECT row, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM d{r} GROUP BY row)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT c, place, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (row) GROUP BY c, place)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c, place, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM c{r} LEFT JOIN s{r} USING (c, place))")
    return rf"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row, unnest(v) AS x, unnest(range(64)) AS place FROM v),
f AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS place, unnest(v) AS y FROM f),
{", ".join(ctes)},
h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (row) JOIN h USING (c)
"""


def queries():
    return {
        "op1_chat_format": op1_chat_format,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_sharding": op3_sharding,
        "op4_bpe": op4_bpe,
        "op5_license_scan": op5_license_scan,
        "op6_topk": op6_topk,
        "op7_ngram_join": op7_ngram_join,
        "op8_passages": op8_passages,
        "op9_language_id": op9_language_id,
        "op10_mixing": op10_mixing,
        "op11_clustering": op11_clustering,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_packing": op13_packing,
    }


def oracle_sql():
    return {"op1_chat_format": OP1, "op2_exact_dedup": OP2, "op5_license_scan": _op5(), "op6_topk": OP6, "op10_mixing": _op10(), "op11_clustering": _op11(), "op12_hard_negatives": OP12}
