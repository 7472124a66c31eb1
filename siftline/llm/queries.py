"""The operators over their whole tables, under the names that the driver calls, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.llm import byte_bpe, decontaminate, jaccard_join, language_id, mixing, ordinal_quality, quality_rules, sharding, token_shards, toxicity, url_filters, vector_codes, yinyang
from siftline.llm._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.rule_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), labels).drop("mined_confidence")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return language_id.identify(table(spark, sf_dir, "documents"), held_out)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold: no row for a clean document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("toxic"), held_out, ~held_out)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a sequence: its slot, shard and place, the document it begins with, and a checksum of its ids."""
    return token_shards.shard_index(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_report(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (poor), 1 (sound, but toxic) and 2 (sound); kept: grade 1 or more is the likelier."""
    grade = F.col("quality") + F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    return ordinal_quality.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), grade)


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings"), size=64)[0]


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of every text's ids, and of the bytes that they decode to."""
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_language_id, op4_source_mixing, op5_sharding, op6_decontamination, op7_toxicity, op8_token_shards, op9_jaccard_join, op10_quality_classifier, op11_yinyang, op12_byte_bpe, op13_vector_codes)}

#: A word, as a class of characters.
_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
toks AS (SELECT r, regexp_extract_all(t, '{_WORD}') AS w FROM docs),
pos AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM toks WHERE len(w) >= 3),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY r),
lns AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM docs),
num AS (
  SELECT docs.doc_id, docs.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs JOIN toks USING (r) JOIN lns USING (r) LEFT JOIN rep USING (r)),
base AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM num),
ruled AS (SELECT *, base_failed OR 100 * n_symbols > {quality_rules.MAX_SYMBOL_PERCENT} * word_chars OR 100 * n_dup_lines > {quality_rules.MAX_DUP_LINE_PERCENT} * n_lines
  OR word_chars > {quality_rules.MAX_MEAN_WORD} * n_words AS rule_failed FROM base),
hosts AS (SELECT source AS host, count(*) AS n, count(*) FILTER (rule_failed) AS k FROM ruled GROUP BY source),
prior AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM hosts),
strength AS (SELECT m, CASE WHEN v > 0 THEN least({quality_rules.PRIOR_BOUNDS[1]}, greatest({quality_rules.PRIOR_BOUNDS[0]}, m * (1 - m) / v - 1)) ELSE {quality_rules.PRIOR_BOUNDS[1]} END AS s FROM prior),
verdicts AS (SELECT host, m, (k + m * s) / (n + s) AS shrunk FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND shrunk <= {quality_rules.REJECT_RATE} AND (shrunk <= m + {quality_rules.WATCH_MARGIN} OR NOT rule_failed) AS kept
FROM ruled JOIN verdicts ON source IS NOT DISTINCT FROM host
"""

_WHOLE = lambda scale: f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SQUARES = "CAST(list_sum(list_transform(v.x, lambda a, i: (a - k.x[i]) * (a - k.x[i]))) AS BIGINT)"
#: floor(s / n) of whole numbers.
_MEAN = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _op11() -> str:
    """Rounds of assignment and floored means, a pair of tables a round."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_WHOLE(yinyang.SCALE)} AS x FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{yinyang.SEED}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {yinyang.CENTROIDS}))",
    ]
    for i in range(yinyang.ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT v.r, k.c, {_SQUARES} AS d FROM v, c{i} k) GROUP BY r)")
        if i < yinyang.ROUNDS:
            parts.append(f"m{i} AS (SELECT c, pos, {_MEAN} AS m FROM (SELECT c, pos, sum(e) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS pos FROM a{i} a JOIN v USING (r)) GROUP BY c, pos))")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(l.x, k.x) AS x FROM c{i} k LEFT JOIN (SELECT c, list(m ORDER BY pos) AS x FROM m{i} GROUP BY c) l USING (c))")
    n = yinyang.ROUNDS
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM v JOIN a{n} a USING (r) JOIN c{n} k ON k.c = a.c"""


def _op13() -> str:
    """The same by part; a part of a vector is a row."""
    p = vector_codes.PARTS
    parts = [
        f"w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, {_WHOLE(vector_codes.SCALE)} AS x FROM embeddings WHERE {_FINITE})",
        f"v AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {p}) + 1 : (p + 1) * (len(x) // {p})] AS x FROM w, range({p}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS c, x FROM v WHERE r <= {vector_codes.ENTRIES})",
    ]
    for i in range(vector_codes.ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, p, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT v.r, v.p, k.c, {_SQUARES} AS d FROM v JOIN c{i} k USING (p)) GROUP BY r, p)")
        if i < vector_codes.ROUNDS:
            parts.append(f"m{i} AS (SELECT p, c, pos, {_MEAN} AS m FROM (SELECT p, c, pos, sum(e) AS s, count(*) AS n FROM (SELECT v.p, a.c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS pos FROM a{i} a JOIN v USING (r, p)) GROUP BY p, c, pos))")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k.p, k.c, coalesce(l.x, k.x) AS x FROM c{i} k LEFT JOIN (SELECT p, c, list(m ORDER BY pos) AS x FROM m{i} GROUP BY p, c) l USING (p, c))")
    n = vector_codes.ROUNDS
    return "WITH " + ",\n".join(parts) + f""",
g AS (SELECT r, string_agg(printf('%02x', c), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{n} GROUP BY r)
SELECT w.vec_id, g.code, g.error, CAST(sum(g.error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, c)) FROM c{n}) AS codebooks_sha256 FROM w JOIN g USING (r)"""


ORACLES = {"op1_quality_rules": _OP1, "op11_yinyang": _op11(), "op13_vector_codes": _op13()}
