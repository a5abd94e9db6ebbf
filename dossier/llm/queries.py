"""The operators of this package as queries over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import (
    dac, fingerprints, jaccard, language, media, merkle, mixing, negatives, packing, quality, sharding, tokens, toxicity,
)
from dossier.llm.common import remainder, settled
from dossier.session import ensure_checkpoint_dir

TOKEN_LIMIT = 512
#: Scores from which a text is good, and toxic.
GOOD_FROM = 0.3
TOXIC_FROM = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an ISO media file, read back through its sample tables."""
    rows = documents(spark, sf_dir).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    stored = media.store_texts(rows).drop("text")
    return media.media_digest(stored).drop("media")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near equal bytes."""
    return sharding.sharded(documents(spark, sf_dir), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under a byte-level encoding."""
    counts = tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality, learnt from good texts and unlabelled ones of four folds in five."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return (
        docs.select("doc_id", language.fold(5, 0).alias("held_out"), quality.quality(docs, model).alias("score"))
        .withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's part in a mix of all sources by weight, and its words in each of 16 shards."""
    mixed = mixing.mix(documents(spark, sf_dir)).withColumn("by_shard", mixing.shard_words())
    taken = F.aggregate("by_shard", F.lit(0).cast("long"), lambda a, x: a + x)
    by_shard = F.array_join(F.col("by_shard").cast("array<string>"), ",")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), by_shard.alias("shard_words"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence of tokens."""
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability under word counts and under the log-bilinear model."""
    return language.language_scores(documents(spark, sf_dir), language.fold(7, 2))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity, by a classifier fitted on labelled texts of four folds in five."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return (
        docs.select("doc_id", language.fold(5, 0).alias("held_out"), toxicity.toxicity(docs, model).alias("t"))
        .select("doc_id", "held_out", "t.score", (F.col("t.score") >= TOXIC_FROM).cast("int").alias("predicted"),
                F.col("t.language").alias("text_language"))
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's component under exact Jaccard links of three-word shingles."""
    return jaccard.near_duplicates(documents(spark, sf_dir), jaccard.Rule(words=3, part=9, whole=10))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's fingerprint, its edited text's, and how alike they are."""
    return fingerprints.compared(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives near the positives of every fiftieth vector, some labels being wrong."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("id") % 50 == 0, label)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in the files written for all of them, as read back from there."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    parts = dac.write(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    found = settled(dac.read(spark, parts))
    dac.remove(folder)
    return found


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest by language, checked against rows of which some are tampered with."""
    tampered = F.when(remainder("doc_id", 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.verified(
        documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], "lang", {"n_chars": tampered}
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_language_model": op7_language_model,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_fingerprints": op10_fingerprints,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_files": op12_token_files,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# How many of ``acc[2]`` draws without replacement from ``acc[1]`` blocks hit one of a source's ``x[1]``:
# the counts whose cumulative probability does not exceed a number from the node and the source.
_LEAST = "greatest(0, acc[2] + x[1] - acc[1])"
_CHANCE = "('0x' || substr(md5('3|' || level || '|' || node || '|' || x[2]), 1, 13))::BIGINT / 4503599627370496.0"
_WEIGHT = """exp(lgamma(x[1] + 1) + lgamma(acc[1] - x[1] + 1) + lgamma(acc[2] + 1) + lgamma(acc[1] - acc[2] + 1) - lgamma(acc[1] + 1)
  - lgamma(j + 1) - lgamma(x[1] - j + 1) - lgamma(acc[2] - j + 1) - lgamma(acc[1] - x[1] - acc[2] + j + 1))"""
DRAWN = f"""(CASE WHEN acc[1] <= 0 OR acc[2] <= 0 OR x[1] <= 0 THEN 0 ELSE least(x[1], acc[2], {_LEAST} + len(list_filter(
  list_transform(range({_LEAST}, least(x[1], acc[2]) + 1), lambda k: list_sum(list_transform(range({_LEAST}, k + 1), lambda j: {_WEIGHT}))),
  lambda c: c <= {_CHANCE}))) END)"""

SQL: dict[str, str] = {
    "op5_mixing": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('3|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
    source_size * 2.0::DOUBLE AS top, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s
), g AS (
  SELECT *, coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(weight) OVER (ORDER BY top / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS waiting FROM w
), f AS (
  SELECT *, top <= weight * (total - given) / waiting AS stopped FROM g
), t AS MATERIALIZED (
  SELECT source, source_size, CASE WHEN stopped THEN top ELSE
    weight * (total - sum(CASE WHEN stopped THEN top ELSE 0 END) OVER ())
      / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () END AS target FROM f
), p AS MATERIALIZED (
  SELECT d.rid, d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS MATERIALIZED (
  SELECT source, target, (floor(target + 0.5)::BIGINT + 8191) // 8192 AS blocks, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM t
), nodes AS (
  SELECT 0 AS level, 0::BIGINT AS node, list(blocks ORDER BY place) AS lots FROM b
  UNION ALL
  SELECT level + 1, node * 2 + side, CASE WHEN side = 0 THEN gone[3:] ELSE list_transform(lots, lambda x, i: x - gone[2 + i]) END
  FROM (SELECT level, node, lots, list_reduce(list_transform(lots, lambda x, i: [x, i]),
      lambda acc, x: list_concat([acc[1] - x[1], acc[2] - """ + DRAWN + r"""], list_append(acc[3:], """ + DRAWN + r""")),
      [list_sum(lots)::BIGINT, ((list_sum(lots) + (node + level) % 2) // 2)::BIGINT]) AS gone FROM nodes WHERE level < 4),
    (VALUES (0), (1)) v(side)
), shards AS MATERIALIZED (
  SELECT b.source, b.blocks AS n, s.shard, s.own, sum(s.own) OVER (PARTITION BY b.place ORDER BY s.shard) - s.own AS before
  FROM (SELECT node AS shard, unnest(lots) AS own, unnest(range(1, len(lots) + 1)) AS place FROM nodes WHERE level = 4) s JOIN b USING (place)
), pieces AS (
  SELECT rid, source, block, least(ending, (block + 1) * 8192) - greatest(start, block * 8192) AS words FROM (
    SELECT *, unnest(range(start // 8192, (ending - 1) // 8192 + 1)) AS block FROM (
      SELECT rid, source, (walk * source_size + first)::BIGINT AS start, least(walk * source_size + first + size, quota)::BIGINT AS ending
      FROM (SELECT *, unnest(range(0, 2)) AS walk FROM p)) WHERE ending > start)
), turns AS (
  SELECT rid, x.source, words, ((block % n) * CASE WHEN 2147483647 % n > 1 AND 2147483647 % n < n - 1 THEN 2147483647
      WHEN 2147483629 % n > 1 AND 2147483629 % n < n - 1 THEN 2147483629 ELSE 2147483587 END
    + ('0x' || substr(md5('3|' || n), 1, 13))::BIGINT % n) % n AS turn
  FROM pieces x JOIN (SELECT source, greatest(blocks, 1) AS n FROM b) y ON x.source IS NOT DISTINCT FROM y.source
), dealt AS (
  SELECT rid, shard, sum(words)::BIGINT AS words FROM turns x JOIN shards s
    ON x.source IS NOT DISTINCT FROM s.source AND x.turn >= s.before AND x.turn < s.before + s.own GROUP BY ALL
), grid AS (
  SELECT p.rid, string_agg(coalesce(e.words, 0)::VARCHAR, ',' ORDER BY k.shard) AS shard_words
  FROM p CROSS JOIN range(0, 16) k(shard) LEFT JOIN dealt e ON e.rid = p.rid AND e.shard = k.shard GROUP BY p.rid
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(first + size, quota) - first)
   + greatest(0, least(source_size + first + size, quota) - source_size - first))::BIGINT AS taken, shard_words
FROM p JOIN grid USING (rid)
""",
    "op9_jaccard_join": r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1),
      lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) c USING (doc_id)
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
      lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)),
      4294967295), 4294967295) % 7 = 0 AS tampered FROM documents
), leaves AS MATERIALIZED (
  SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + tampered::INT), '-') || tail) AS claimed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM fields
), trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2),
    lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM trees WHERE len(nodes) > 1
), subroots AS MATERIALIZED (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM trees WHERE len(nodes) = 1
), over_all AS (
  SELECT 1000 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2),
    lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM over_all WHERE len(nodes) > 1
), places AS (
  SELECT l.rid, t.level, t.nodes, l.pos >> t.level AS own FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
  UNION ALL
  SELECT l.rid, o.level, o.nodes, s.pos >> (o.level - 1000)
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, over_all o WHERE len(o.nodes) > 1
), steps AS (
  SELECT rid, list(CASE WHEN xor(own, 1) >= len(nodes) THEN '' WHEN own % 2 = 1 THEN '<' || nodes[own]
    ELSE '>' || nodes[own + 2] END ORDER BY level) AS way FROM places GROUP BY rid
), proofs AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT nodes[1] FROM over_all WHERE len(nodes) = 1) AS root,
    sha256(array_to_string(list_transform(coalesce(w.way, []), lambda x: x[2:]), '')) AS proof_sha256,
    list_reduce(coalesce(w.way, []), lambda a, x: CASE WHEN x[1] = '<' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END, l.claimed) AS folded_root
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN steps w USING (rid)
)
SELECT *, folded_root = root AS verified FROM proofs
""",
}
