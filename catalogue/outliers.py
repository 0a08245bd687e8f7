"""Registered queries: outlier detection."""

from pyspark.sql import functions as F

from catalogue.registry import query
from quadrat.functions.distributions import chi2_ppf
from quadrat.operators import outliers, table


def limits_sql(column: str, source: str, k: float = 1.5, z: float = 3.0, m: float = 3.5) -> str:
    """CTEs iqr, zs and md with (low, high) of one column."""
    return f"""
med AS (SELECT median({column}) AS c, mad({column}) AS d FROM {source}),
q AS (SELECT quantile_cont({column}, 0.25) AS a, quantile_cont({column}, 0.75) AS b FROM {source}),
iqr AS (SELECT a - {k} * (b - a) AS low, b + {k} * (b - a) AS high FROM q),
zs AS (SELECT avg({column}) - {z} * stddev_pop({column}) AS low, avg({column}) + {z} * stddev_pop({column}) AS high FROM {source}),
md AS (SELECT c - {m / 0.6745!r} * d AS low, c + {m / 0.6745!r} * d AS high FROM med)"""


@query(f"""
WITH {limits_sql("value", "events")}
SELECT event_id, value FROM events, iqr WHERE value < low OR value > high""")
def iqr_outliers(t):
    return outliers.iqr_outliers(t("events"), "value", "event_id")


@query(f"""
WITH {limits_sql("value", "events")}
SELECT event_id, value FROM events, zs WHERE value < low OR value > high""")
def zscore_outliers(t):
    return outliers.zscore_outliers(t("events"), "value", "event_id")


@query(f"""
WITH {limits_sql("value", "events")}
SELECT event_id, value FROM events, md WHERE value < low OR value > high""")
def mad_outliers(t):
    return outliers.mad_outliers(t("events"), "value", "event_id")


@query(f"""
WITH {limits_sql("value", "events")}, o AS (SELECT count(*) AS outliers FROM events, iqr WHERE value < low OR value > high)
SELECT outliers, rows, round(outliers / rows, 6) + 0.0 AS ratio FROM o, (SELECT count(*) AS rows FROM events)""")
def outlier_ratio(t):
    found = outliers.iqr_outliers(t("events"), "value", "event_id")
    return outliers.outlier_ratio(t("events"), found)


def detect_sql(column: str, key: str, source: str, categories: str) -> str:
    """Outliers of one column by all three methods."""
    return f"""
SELECT * FROM (WITH {limits_sql(column, source)},
lim AS (SELECT 'iqr' AS method, * FROM iqr UNION ALL SELECT 'zscore', * FROM zs UNION ALL SELECT 'mad', * FROM md)
SELECT method, '{column}' AS feature, {key}, round(CAST({column} AS DOUBLE), 6) + 0.0 AS value, {categories}
FROM {source}, lim WHERE {column} < low OR {column} > high)"""


@query(" UNION ALL ".join(
    detect_sql(c, "event_id", "(SELECT *, length(props) AS props_chars FROM events)", "event_type")
    for c in ["value", "props_chars"]))
def detect_univariate(t):
    rows = t("events").withColumn("props_chars", F.length("props"))
    return outliers.detect_univariate(rows, ["event_type"], "event_id", ["value", "props_chars"])


@query(f"""
WITH {limits_sql("value", "events")}
SELECT event_id, value FROM events, iqr, zs
WHERE (value < iqr.low OR value > iqr.high) AND (value < zs.low OR value > zs.high)""")
def flag_overlap(t):
    first = outliers.iqr_outliers(t("events"), "value", "event_id")
    second = outliers.zscore_outliers(t("events"), "value", "event_id")
    return table.flag_overlap(first, second, "event_id")


@query(f"""
WITH o AS ({detect_sql("value", "event_id", "events", "event_type")})
SELECT event_id, feature, count(DISTINCT method) AS methods FROM o GROUP BY 1, 2 HAVING count(DISTINCT method) >= 2""")
def consensus_outliers(t):
    found = outliers.detect_univariate(t("events"), ["event_type"], "event_id", ["value"])
    return table.consensus_outliers([found], "event_id", 2)


PAIR = """
m AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, var_samp(l_quantity) AS vx, var_samp(l_discount) AS vy,
  covar_samp(l_quantity, l_discount) AS c FROM lineitem),
s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity, l_discount,
  (vy * (l_quantity - mx) ^ 2 - 2 * c * (l_quantity - mx) * (l_discount - my) + vx * (l_discount - my) ^ 2)
  / (vx * vy - c * c) AS d FROM lineitem, m)"""
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(f"WITH {PAIR} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(d, 6) + 0.0 AS mahalanobis_score FROM s")
def mahalanobis_score(t):
    scored = outliers.mahalanobis_score(t("lineitem"), ["l_quantity", "l_discount"])
    return scored.select(*KEYS, "mahalanobis_score")


@query(f"""
WITH {PAIR} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(d, 6) + 0.0 AS mahalanobis_score,
  round(exp(-d / 2), 6) + 0.0 AS mahalanobis_p_value FROM s WHERE d > {chi2_ppf(0.9, 2)!r}""")
def mahalanobis_outliers(t):
    found = outliers.mahalanobis_outliers(t("lineitem"), ["l_quantity", "l_discount"], alpha=0.1)
    return found.select(*KEYS, "mahalanobis_score", "mahalanobis_p_value")


@query(f"""
WITH {PAIR}, v AS (SELECT l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT * FROM (SELECT a.l_quantity AS left_quantity, a.l_discount AS left_discount, b.l_quantity AS right_quantity,
  b.l_discount AS right_discount, a.n AS rows_left, b.n AS rows_right,
  round(sqrt((vy * (a.l_quantity - b.l_quantity) ^ 2 - 2 * c * (a.l_quantity - b.l_quantity) * (a.l_discount - b.l_discount)
  + vx * (a.l_discount - b.l_discount) ^ 2) / (vx * vy - c * c)), 6) + 0.0 AS distance
FROM v a JOIN v b ON (a.l_quantity, a.l_discount) < (b.l_quantity, b.l_discount), m) WHERE distance <= 0.4""")
def mahalanobis_pairs(t):
    pairs = outliers.mahalanobis_pairs(t("lineitem"), ["l_quantity", "l_discount"], 0.4)
    return pairs.select(
        F.col("left.l_quantity").alias("left_quantity"), F.col("left.l_discount").alias("left_discount"),
        F.col("right.l_quantity").alias("right_quantity"), F.col("right.l_discount").alias("right_discount"),
        "rows_left", "rows_right", "distance",
    )


@query(f"""
WITH {PAIR} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
  CASE WHEN d > {chi2_ppf(0.95, 2)!r} THEN 'outlier' ELSE 'kept' END AS part FROM s""")
def detect_multivariate(t):
    rows = t("lineitem").withColumn("key", F.struct(*KEYS))
    found, kept = outliers.detect_multivariate(
        rows, ["l_returnflag"], "key", ["l_quantity", "l_discount"], alpha=0.05
    )
    both = found.select("key", "l_returnflag", F.lit("outlier").alias("part")).unionAll(
        kept.select("key", "l_returnflag", F.lit("kept").alias("part"))
    )
    return both.select("key.*", "l_returnflag", "part")
