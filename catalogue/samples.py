"""Registered queries: reproducible samples, splits, folds and ranks."""

from pyspark.sql import functions as F

from catalogue.registry import query
from quadrat.operators import quantiles, sampling


def md5_of(key: str, seed: int = 42) -> str:
    """The order hash in SQL."""
    return f"md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}'))"


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {md5_of('o_orderkey')} LIMIT 5", digits=2)
def preview(t):
    return sampling.preview(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query(f"""
SELECT parameter, value, p_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY parameter, value ORDER BY {md5_of('p_partkey')}) AS i FROM (
    SELECT 'p_brand' AS parameter, p_brand AS value, p_partkey FROM part
    UNION ALL SELECT 'p_type', p_type, p_partkey FROM part)) WHERE i = 1""")
def sample_per_value(t):
    rows = sampling.sample_per_value(t("part"), ["p_brand", "p_type"], ["p_partkey"])
    return rows.select("parameter", "value", "p_partkey")


@query(f"""
SELECT o_orderkey, CASE WHEN i <= round(n * 0.6) THEN 'train' WHEN i <= round(n * (0.6 + 0.2)) THEN 'valid'
  ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {md5_of('o_orderkey')}) AS i, count(*) OVER () AS n FROM orders)""")
def split_train_valid_test(t):
    return sampling.split_train_valid_test(t("orders").select("o_orderkey"), ["o_orderkey"])


@query(f"""
SELECT event_id, event_type, CASE WHEN i <= round(n * 0.6) THEN 'train' ELSE 'test' END AS split
FROM (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n,
  row_number() OVER (PARTITION BY event_type ORDER BY {md5_of('event_id')}) AS i FROM events)""")
def split_stratified(t):
    rows = t("events").select("event_id", "event_type")
    return sampling.split_stratified(rows, "event_type", ["event_id"])


@query(f"""
SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY {md5_of('event_id')}) - 1) % 5
  AS INTEGER) AS fold FROM events""")
def stratified_folds(t):
    rows = t("events").select("event_id", "event_type")
    return sampling.stratified_folds(rows, "event_type", 5, ["event_id"])


@query("""
WITH s AS (SELECT p_brand, count(*) * 100.0 / (SELECT count(*) FROM part) AS percent FROM part GROUP BY 1)
SELECT p_brand, round(percent, 6) + 0.0 AS percent,
  round(sum(percent) OVER (ORDER BY p_brand), 6) + 0.0 AS cumulated FROM s""")
def cumulative_share(t):
    return _brand_share(t)


def _brand_share(t):
    rows = t("part").agg(F.count(F.lit(1))).scalar()
    share = t("part").groupBy("p_brand").agg((F.count(F.lit(1)) * 100.0 / rows).alias("percent"))
    return sampling.cumulative_share(share, "p_brand", "percent")


@query("""
WITH s AS (SELECT p_brand, count(*) * 100.0 / (SELECT count(*) FROM part) AS percent FROM part GROUP BY 1),
c AS (SELECT p_brand, percent, sum(percent) OVER (ORDER BY p_brand) AS cumulated FROM s)
SELECT p_brand, round(percent, 6) + 0.0 AS percent, round(cumulated, 6) + 0.0 AS cumulated FROM c
WHERE p_brand <= (SELECT min(p_brand) FROM c WHERE cumulated >= 50)""")
def cut_at(t):
    return sampling.cut_at(_brand_share(t), "p_brand", "cumulated", 50.0)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", digits=2)
def top_k(t):
    return sampling.top_k(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, ["o_orderkey"])


@query("""
SELECT value, n, first, first + n - 1 AS last, first + (n - 1) / 2.0 AS rank FROM (
  SELECT DISTINCT CAST(n_chars AS DOUBLE) AS value, count(*) OVER (PARTITION BY n_chars) AS n,
    rank() OVER (ORDER BY n_chars) AS first FROM documents)""")
def ranked_values(t):
    return quantiles.ranked_values(t("documents"), "n_chars")


@query("""
SELECT event_id, value, row_number() OVER (ORDER BY value, md5(concat_ws('|', CAST(event_id AS VARCHAR), '0'))) AS rank
FROM events""", digits=4)
def rank_global(t):
    return quantiles.rank_global(t("events").select("event_id", "value"), "value", ["event_id"])


@query("""
SELECT event_id, 9007199254740992 + user_id AS v,
  row_number() OVER (ORDER BY user_id, md5(concat_ws('|', CAST(event_id AS VARCHAR), '0'))) AS rank
FROM events""")
def rank_global_large(t):
    rows = t("events").select("event_id", (F.lit(2**53) + F.col("user_id")).alias("v"))
    return quantiles.rank_global(rows, "v", ["event_id"])
