"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlens.llm.common import scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


@register("op1_pack_power_of_two")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


@register("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.token_files import file_digests, write_token_files

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return file_digests(spark, path)


@register("op5_simhash_anchors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op10_spaced_seed_leaks")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scaled=True).drop("text_hash")


@register("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


@register("op9_crf_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.pii import KINDS, find_personal_data
    from crewlens.llm.spans import base_spans, count_kind, written

    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written(base_spans(F.col("spans"))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


@register("op7_grammar_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.secrets import BASE_KINDS, find_secrets
    from crewlens.llm.spans import base_spans, count_kind, written

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(written(base_spans(F.col("spans"))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


@register("op6_kd_tree_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.sharding import kd_shards

    return kd_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op2_epsilon_grid_order")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op3_kneser_ney")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.ngram_lm import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents"), order=3)


@register("op11_suffix_levels")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.suffix_dedup import remove_long_repeats

    return remove_long_repeats(table(spark, sf_dir, "documents"))


@register("op12_hard_negatives")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.hard_negatives import mine_hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@register("op13_filter_interactions")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crewlens.llm.filter_audit import filter_interactions

    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# -- DuckDB twins, where SQL can express an operator: all pairs, no index ------
ORACLE["op2_epsilon_grid_order"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, c) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.c = p.a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least(v.vec_id, coalesce(m.c, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(m.c, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id
"""

# The scaled rule. Of `wide` aligned tokens at least floor((4 wide + 4) / 5) equal: from two tokens on some two in
# a row are equal (of 13 with 2 unequal, some 4), so pairs of tokens find every candidate diagonal.
ORACLE["op10_spaced_seed_leaks"] = r"""
WITH t AS (SELECT '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]{5}' AS unspaced),
d AS (SELECT row_number() OVER () AS u, doc_id, w FROM (SELECT DISTINCT doc_id, text,
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), t
  WHERE len(w) > 1 OR (len(w) = 1 AND regexp_matches(w[1], unspaced))),
i AS (SELECT row_number() OVER () AS k, item_id, w FROM (SELECT DISTINCT item_id,
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), t
  WHERE len(w) > 1 OR (len(w) = 1 AND regexp_matches(w[1], unspaced))),
ds AS (SELECT u, p, w[p + 1] || ' ' || w[p + 2] AS s FROM (SELECT u, w, unnest(range(0, len(w) - 1)) AS p FROM d)),
ik AS (SELECT k, q, w[q + 1] || ' ' || w[q + 2] AS s FROM (SELECT k, w, unnest(range(0, len(w) - 1)) AS q FROM i)),
one AS (SELECT d.u, i.k, d.p - i.q AS g FROM (SELECT u, w[p + 1] AS s, p, n FROM (SELECT u, w, len(w) AS n, unnest(range(0, len(w))) AS p FROM d)) d
  JOIN (SELECT k, w[q + 1] AS s, q, n FROM (SELECT k, w, len(w) AS n, unnest(range(0, len(w))) AS q FROM i)) i
    ON d.s = i.s AND (d.n = 1 OR i.n = 1)),
g AS (SELECT u, k, p - q AS g FROM ds JOIN ik ON ds.s = ik.s UNION SELECT u, k, g FROM one),
e AS (SELECT d.doc_id, i.item_id, g.g, len(i.w) AS n, least(13, len(i.w), len(d.w)) AS wide,
    list_transform(range(greatest(-g.g, 0), least(len(i.w), len(d.w) - g.g)), lambda x: CASE WHEN d.w[g.g + x + 1] = i.w[x + 1] THEN 1 ELSE 0 END) AS q
  FROM g JOIN d ON d.u = g.u JOIN i ON i.k = g.k),
f AS (SELECT *, list_max(list_transform(range(0, len(q) - wide + 1), lambda x: list_sum(q[x + 1:x + wide]))) AS best FROM e
  WHERE list_sum(q) >= (4 * wide + 4) // 5)
SELECT doc_id, item_id, CAST(g AS int) AS doc_token, CAST(n AS int) AS item_tokens, CAST(list_sum(q) AS int) AS equal_tokens,
  CAST(best AS int) AS window_equal
FROM f WHERE best >= (4 * wide + 4) // 5
"""

ORACLE["op13_filter_interactions"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w,
    min(doc_id) OVER (PARTITION BY x) AS first_id FROM t),
m AS (SELECT doc_id, part, CAST(len(w) < 100 AS int) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS int)
    + 4 * CAST(100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) AS int)
    + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS int) + 16 * CAST(coalesce(doc_id > first_id, false) AS int) AS m FROM w),
l AS (SELECT m.*, EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = m.doc_id AND b.quality = 1) AS g,
    EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = m.doc_id AND b.toxic = 1) AS x FROM m),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE g) AS g, count(*) FILTER (WHERE x) AS x FROM l GROUP BY part, m),
f(f) AS (SELECT unnest(['A', 'B', 'C', 'D', 'E'])),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, s, CAST(pow(2, ascii(o[s]) - 65) AS int) AS own,
    CAST(coalesce(list_sum(list_transform(range(1, s), lambda i: pow(2, ascii(o[i]) - 65))), 0) AS int) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS s)),
r AS (SELECT part, o, s, own, CAST(sum(CASE WHEN m & (own | before) = 0 THEN n ELSE 0 END) AS bigint) AS kept,
    CAST(sum(CASE WHEN m & own <> 0 AND m & before = 0 THEN n ELSE 0 END) AS bigint) AS removed,
    CAST(sum(CASE WHEN m & own <> 0 AND m & before <> 0 THEN n ELSE 0 END) AS bigint) AS redundant,
    CAST(sum(CASE WHEN m = own THEN n ELSE 0 END) AS bigint) AS unique_fails,
    CAST(sum(CASE WHEN m & own <> 0 AND m & before = 0 THEN g ELSE 0 END) AS bigint) AS good_lost,
    CAST(sum(CASE WHEN m & own <> 0 AND m & before = 0 THEN x ELSE 0 END) AS bigint) AS toxic_lost
  FROM c, s GROUP BY part, o, s, own)
SELECT part, o AS filter_order, CAST(s AS int) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS bigint) AS shapley
FROM r
"""

ORACLE["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS double[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS bigint) AS s
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, c, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5),
n AS (SELECT p.a, p.c AS p, p.s AS ps, s.c AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.s DESC, s.c) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS int) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE r <= 5
"""
