"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import (
    hard_negatives, mixing, packing, pages, quality, resampling, simhash, substrings, suffix_order, token_counts, token_files, toxicity,
    vectors,
)
from quadrat.operators.durable import checkpoint_folder

END_ID = 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out() -> F.Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_pages(table(spark, folder, "pages"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit_rows(docs, table(spark, folder, "labels").where(~held_out()))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents")).drop("fp")


def op7_sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the documents with a checksum for their ids."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").where("quality = 1")
    return quality.quality_rules(table(spark, folder, "documents"), trusted)


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.linked_vectors(table(spark, folder, "embeddings"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_order.remove_repeated_bytes(table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_substring_dedup, op3_token_counts, op4_source_mixing, op5_toxicity, op6_simhash_dedup,
        op7_sequence_packing, op8_token_files, op9_quality_rules, op10_embedding_dedup, op11_importance_resampling,
        op12_suffix_array_dedup, op13_hard_negatives,
    )
}

MIXING_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    md5('1|' || doc_id) AS mark
  FROM documents),
sources AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY source HAVING sum(n_tokens) > 0),
shares AS (SELECT list(tokens / total) AS p, any_value(total) AS total, count(*) AS k
  FROM sources, (SELECT sum(tokens) AS total FROM sources)),
-- The largest exponent that reaches the entropy, then the smallest that keeps the repetition limit.
high(i, low) AS (
  SELECT 0, 0.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ln(list_sum([pow(x, a) for x in p])) - a * list_sum([pow(x, a) * ln(x) for x in p]) / list_sum([pow(x, a) for x in p])
    >= 0.95 * ln(k) THEN a ELSE low END
  FROM (SELECT i, low, low + pow(0.5, i + 1) AS a, p, k FROM high, shares WHERE i < 30)),
low(i, low) AS (
  SELECT 0, 0.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN list_max([pow(x, a) / x for x in p]) / list_sum([pow(x, a) for x in p]) > 4.0 THEN a ELSE low END
  FROM (SELECT i, low, low + pow(0.5, i + 1) AS a, p, k FROM low, shares WHERE i < 30)),
exponent AS (
  SELECT greatest(
    CASE WHEN -list_sum([x * ln(x) for x in p]) >= 0.95 * ln(k) THEN 1.0 ELSE h.low END,
    CASE WHEN list_max([1 / x for x in p]) / k > 4.0 THEN l.low + pow(0.5, 30) ELSE 0.0 END) AS a
  FROM shares, (SELECT low FROM high WHERE i = 30) h, (SELECT low FROM low WHERE i = 30) l),
plan AS (
  SELECT source, (b // tokens)::BIGINT AS passes, (b % tokens)::BIGINT AS rest, least(65536, ceil(tokens / 1048576))::BIGINT AS blocks
  FROM (SELECT source, tokens, floor(pow(tokens / total, a) / list_sum([pow(x, a) for x in p]) * total)::BIGINT AS b
    FROM sources, shares, exponent)),
drawn AS (
  SELECT doc_id, source, n_tokens, unnest(range(passes + 1)) AS epoch, passes, rest,
    (list_sum([(instr('0123456789abcdef', substr(mark, i, 1)) - 1) * pow(16, 8 - i) for i in range(1, 9)])::BIGINT) % blocks AS block
  FROM docs JOIN plan USING (source)),
starts AS (
  SELECT source, epoch, block, sum(size) OVER (PARTITION BY source, epoch ORDER BY md5('1|' || epoch || '|' || block), block) - size AS before
  FROM (SELECT source, epoch, block, sum(n_tokens) AS size FROM drawn GROUP BY ALL)),
placed AS (
  SELECT *, before + sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY md5('1|' || epoch || '|' || doc_id), doc_id
    ROWS UNBOUNDED PRECEDING) AS until
  FROM drawn JOIN starts USING (source, epoch, block))
SELECT doc_id, source, n_tokens, epoch, (until - n_tokens)::BIGINT AS token_start FROM placed WHERE epoch < passes OR until <= rest"""

RESAMPLING_SQL = r"""
WITH signs AS (SELECT [list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    FOR n IN range(256)] AS crc),
raw AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS parts FROM documents),
docs AS (SELECT doc_id, list_filter(parts, lambda w: w <> '') AS words FROM raw),
wanted AS (SELECT unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
used AS (SELECT doc_id, unnest(words) AS word FROM docs),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, [
    16 * (instr('0123456789ABCDEF', substr(bytes, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(bytes, 2 * i + 2, 1)) - 1
    FOR i IN range(len(bytes) // 2)]), lambda c, b: xor(c >> 8, crc[xor(c % 256, b) + 1]))) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS bytes FROM (SELECT word FROM used UNION SELECT word FROM wanted WHERE word <> '')), signs),
s AS (SELECT bucket, count(*) AS n FROM used JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (word) GROUP BY 1),
gains AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM used JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT)::BIGINT AS score
  FROM (SELECT doc_id, words, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM docs) LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""

NEGATIVES_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_append([x IS NOT NULL AND isfinite(x) FOR x IN embedding], true))),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER near::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW near AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY rank <= 10"""

STRINGS_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
parts AS (SELECT doc_id, n, 500 * b AS base, substr(x, 1000 * b + 1, 1098) AS part FROM docs, unnest(range((n + 499) // 500)) AS t(b)),
starts AS (SELECT doc_id, base + i AS place, md5_number(substr(part, 2 * i + 1, 100)) AS string FROM parts, unnest(range(least(500, n - 49 - base))) AS t(i)),
least_doc AS (SELECT string, min(doc_id) AS first_doc FROM starts GROUP BY string),
hits AS (SELECT doc_id, place FROM starts JOIN least_doc USING (string) WHERE doc_id > first_doc),
marked AS (SELECT doc_id, place, lag(place) OVER w AS previous FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
runs AS (SELECT doc_id, place, sum(CASE WHEN place - previous <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM marked),
spans AS (SELECT doc_id, run, min(place) AS a, max(place) + 50 AS b FROM runs GROUP BY ALL),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cuts AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last,
  string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM docs LEFT JOIN cuts USING (doc_id)"""

CHECKS = {
    "op4_source_mixing": MIXING_SQL,
    "op11_importance_resampling": RESAMPLING_SQL,
    "op12_suffix_array_dedup": STRINGS_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
