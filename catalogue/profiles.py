"""Registered queries: profiles, grouped summaries and association."""

from pyspark.sql import functions as F

from catalogue.registry import query
from catalogue.tables import GAPS, with_gaps
from quadrat.operators import profile, quantiles

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def profile_sql(name: str, label: str, source: str) -> str:
    """The profile row of one column."""
    return f"""
SELECT '{name}' AS feature, '{label}' AS label, count({name}) AS count,
  count(*) FILTER ({name} IS NULL) AS missing,
  round(avg({name}), 4) + 0.0 AS mean, round(stddev_samp({name}), 4) + 0.0 AS std,
  round(min({name}), 4) + 0.0 AS min, round(quantile_cont({name}, 0.25), 4) + 0.0 AS p25,
  round(quantile_cont({name}, 0.5), 4) + 0.0 AS p50, round(quantile_cont({name}, 0.75), 4) + 0.0 AS p75,
  round(max({name}), 4) + 0.0 AS max,
  round(stddev_samp({name}) * 100 / nullif(avg({name}), 0), 4) + 0.0 AS pct_var,
  round(mad({name}) / 0.6744897501960817, 4) + 0.0 AS mad,
  round(kurtosis({name}), 4) + 0.0 AS kurt, round(skewness({name}), 4) + 0.0 AS skew FROM {source}"""


@query(" UNION ALL ".join(
    profile_sql(c, label, "lineitem") for c, label in zip(
        LINE, ["L Quantity", "L Extendedprice", "L Discount", "L Tax"], strict=True)), digits=4)
def numeric_profile(t):
    return profile.numeric_profile(t("lineitem"), LINE)


@query(profile_sql("value", "Value", "(SELECT nullif(value, 6.55) AS value FROM events)"), digits=4)
def numeric_profile_with_gaps(t):
    gaps = t("events").withColumn("value", F.nullif("value", F.lit(6.55)))
    return profile.numeric_profile(gaps, ["value"])


@query("""
SELECT 'c_acctbal' AS feature, round(mad(c_acctbal) / 0.6744897501960817, 6) + 0.0 AS mad FROM customer""")
def robust_mad(t):
    return quantiles.robust_mad(t("customer"), ["c_acctbal"])


@query("""
SELECT o_orderpriority, 'o_totalprice' AS feature, count(*) AS n,
  round(quantile_cont(o_totalprice, 0.1), 4) + 0.0 AS q0, round(quantile_cont(o_totalprice, 0.5), 4) + 0.0 AS q1,
  round(quantile_cont(o_totalprice, 0.99), 4) + 0.0 AS q2 FROM orders GROUP BY o_orderpriority""", digits=4)
def group_quantiles(t):
    return quantiles.quantile_table(
        t("orders"), ["o_totalprice"], [0.1, 0.5, 0.99], ["o_orderpriority"]
    )


@query("""
SELECT l_returnflag, 'l_extendedprice' AS feature, count(*) AS n,
  round(quantile_cont(l_extendedprice, 0.1), 4) + 0.0 AS q0, round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0 AS q1,
  round(quantile_cont(l_extendedprice, 0.99), 4) + 0.0 AS q2 FROM lineitem GROUP BY l_returnflag""", digits=4)
def group_quantiles_lineitem(t):
    """Groups large enough to be bracketed by sketches."""
    return quantiles.quantile_table(
        t("lineitem"), ["l_extendedprice"], [0.1, 0.5, 0.99], ["l_returnflag"]
    )


def frequent_sql(column: str, source: str) -> str:
    """The categorical profile row of one column."""
    return f"""
SELECT * FROM (SELECT '{column}' AS feature, CAST(sum(n) OVER () AS BIGINT) AS count,
  count(*) OVER () AS "unique", v AS top, n AS freq
  FROM (SELECT {column} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)
  ORDER BY n DESC, v LIMIT 1)"""


@query(" UNION ALL ".join(frequent_sql(c, "part") for c in ["p_brand", "p_type", "p_name"]))
def categorical_profile(t):
    return profile.categorical_profile(t("part"), ["p_brand", "p_type", "p_name"])


@query(f"""
SELECT 'o_orderpriority' AS feature, count({GAPS}) AS present, count(*) - count({GAPS}) AS missing,
  count(*) AS total, round((count(*) - count({GAPS})) * 100.0 / count(*), 6) + 0.0 AS percent FROM orders""")
def missing_table(t):
    return profile.missing_table(with_gaps(t("orders")))


@query(f"""
SELECT o_orderkey, 1 AS o_orderstatus, CAST({GAPS} IS NOT NULL AS INTEGER) AS o_orderpriority,
  CAST({GAPS} IS NOT NULL AS INTEGER) + 1 AS completeness FROM orders""")
def missing_matrix(t):
    rows = with_gaps(t("orders")).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return profile.missing_matrix(rows, ["o_orderkey"])


@query(f"""
SELECT '1' || CAST(CAST({GAPS} IS NOT NULL AS INTEGER) AS VARCHAR) AS pattern, count(*) AS rows,
  CAST(CAST({GAPS} IS NOT NULL AS INTEGER) + 1 AS INTEGER) AS completeness FROM orders GROUP BY 1, 3""")
def missing_patterns(t):
    rows = with_gaps(t("orders")).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return profile.missing_patterns(rows, ["o_orderkey"])


@query(f"""
SELECT o_orderpriority,
  round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) + 0.0 AS "F_o_totalprice_mean",
  round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) + 0.0 AS "O_o_totalprice_mean",
  round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) + 0.0 AS "P_o_totalprice_mean"
FROM (SELECT * REPLACE ({GAPS} AS o_orderpriority) FROM orders)
WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""", digits=4)
def pivot_to_aggregate(t):
    return profile.pivot_to_aggregate(
        with_gaps(t("orders")), ["o_orderpriority"], "o_orderstatus", ["o_totalprice"],
        ["mean"], pivot_values=["F", "O", "P"],
    )


@query("""
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) + 0.0 AS mean,
  round(stddev_samp(l_quantity), 6) + 0.0 AS std FROM lineitem
GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1""")
def group_mean_std(t):
    return profile.group_mean_std(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query(f"SELECT {GAPS} AS o_orderpriority, count(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def group_count(t):
    return profile.group_count(with_gaps(t("orders")), ["o_orderpriority"], ["o_totalprice"])


@query("SELECT role, count(*) AS items FROM conversations GROUP BY role")
def value_counts(t):
    return profile.value_counts(t("conversations"), "role")


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd,
  round(stddev_samp(value) / sqrt(count(*)), 6) + 0.0 AS se FROM events GROUP BY event_type""")
def group_interval(t):
    # group_interval_bounds has the interval
    return profile.group_interval(t("events"), "value", "event_type").drop("ci_low", "ci_high")


def t_bound(n: str) -> str:
    """The 97.5 % point of Student's t with n - 1 degrees of freedom, by its series in 1 / (n - 1) around the normal one.

    The first omitted term is below 1e-7 from 60 degrees of freedom on.
    """
    z, v = 1.959963984540054, f"({n} - 1)"
    terms = [
        (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    return f"({z!r}::DOUBLE" + "".join(f" + {x!r} / pow({v}, {i + 1})" for i, x in enumerate(terms)) + ")"


@query(f"""
SELECT event_type, n, round(m, 6) + 0.0 AS mean, round(s, 6) + 0.0 AS sd, round(s / sqrt(n), 6) + 0.0 AS se,
  round(m - {t_bound("n")} * s / sqrt(n), 6) + 0.0 AS ci_low, round(m + {t_bound("n")} * s / sqrt(n), 6) + 0.0 AS ci_high
FROM (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)""")
def group_interval_bounds(t):
    return profile.group_interval(t("events"), "value", "event_type")


def corr_sql(columns, source, labels=None) -> str:
    """Rows (x, y, r) for i<j."""
    labels = labels or columns
    return " UNION ALL ".join(
        f"SELECT '{labels[i]}' AS x, '{labels[j]}' AS y, round(corr({columns[i]}, {columns[j]}), 6) + 0.0 AS r FROM {source}"
        for i in range(len(columns)) for j in range(i + 1, len(columns)))


@query(corr_sql(LINE, "lineitem"))
def correlation_pearson(t):
    return profile.correlation_pairs(t("lineitem"), LINE)


@query(f"""
WITH p AS ({corr_sql(LINE, "lineitem")})
SELECT * FROM p UNION ALL SELECT y, x, r FROM p
UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS x, x, 1.0""")
def correlation_matrix(t):
    return profile.correlation_matrix(t("lineitem"), LINE)


AVERAGE_RANKS = """
SELECT rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2.0 AS b FROM {2}"""


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr(a, b), 6) + 0.0 AS r FROM ({AVERAGE_RANKS.format(a, b, 'lineitem')})"
    for a, b in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"),
                 ("l_extendedprice", "l_discount")]))
def correlation_spearman(t):
    return profile.correlation_pairs(t("lineitem"), LINE[:3], "spearman")


@query("""
WITH c AS (SELECT quality AS x, n_chars AS y, count(*) AS w FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
s AS (SELECT sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2.0 AS s FROM c a, c b),
n AS (SELECT sum(w) AS n FROM c),
tx AS (SELECT sum(w * (w - 1) / 2.0) AS t FROM (SELECT sum(w) AS w FROM c GROUP BY x)),
ty AS (SELECT sum(w * (w - 1) / 2.0) AS t FROM (SELECT sum(w) AS w FROM c GROUP BY y))
SELECT 'quality' AS x, 'n_chars' AS y,
  round(s / sqrt((n * (n - 1) / 2.0 - tx.t) * (n * (n - 1) / 2.0 - ty.t)), 6) + 0.0 AS r FROM s, n, tx, ty""")
def correlation_kendall(t):
    joined = t("labels").join(t("documents"), "doc_id")
    return profile.correlation_pairs(joined, ["quality", "n_chars"], "kendall")


@query(corr_sql(LINE, "lineitem").replace("corr(", "covar_samp(").replace(", 6)", ", 2)") + "".join(
    f" UNION ALL SELECT '{c}', '{c}', round(var_samp({c}), 2) + 0.0 FROM lineitem" for c in LINE), digits=2)
def covariance_pairs(t):
    return profile.covariance_pairs(t("lineitem"), LINE)


@query(corr_sql(LINE, "lineitem", ["L Quantity", "L Extendedprice", "L Discount", "L Tax"])
       .replace(" AS x,", " AS k,").replace(" AS y,", " AS x,").replace(" AS k,", " AS y,"))
def correlation_long(t):
    return profile.correlation_long(t("lineitem"), LINE)


@query("""
WITH m AS (SELECT avg(value) AS g, var_pop(value) AS v FROM events),
b AS (SELECT sum(n * (a - g) * (a - g)) AS b, sum(n) AS n
      FROM (SELECT count(*) AS n, avg(value) AS a FROM events GROUP BY event_type), m)
SELECT 'event_type' AS category, 'value' AS feature, round(sqrt(b / (n * v)), 6) + 0.0 AS eta FROM m, b""")
def correlation_ratio(t):
    return profile.correlation_ratio(t("events"), "event_type", ["value"])


@query("""
WITH c AS (SELECT p_brand AS x, p_type AS y, count(*) AS n FROM part GROUP BY 1, 2),
t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c),
hx AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT sum(n) AS n FROM c GROUP BY x), t),
hy AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT sum(n) AS n FROM c GROUP BY y), t),
hxy AS (SELECT -sum(n / t * ln(n / t)) AS h FROM c, t)
SELECT 'p_brand' AS x, 'p_type' AS y, round((hx.h - (hxy.h - hy.h)) / hx.h, 6) + 0.0 AS u FROM hx, hy, hxy""")
def uncertainty_coefficient(t):
    return profile.uncertainty_coefficient(t("part"), "p_brand", "p_type")


@query("""
WITH r AS (SELECT CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN value END AS value, event_type FROM events)
SELECT 'value' AS feature, count(value) AS present, count(*) - count(value) AS missing, count(*) AS total,
  round(100.0 * (count(*) - count(value)) / count(*), 6) + 0.0 AS percent FROM r HAVING count(*) > count(value)""")
def missing_table_nan(t):
    gaps = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 3 != 0, F.col("value"))
    return profile.missing_table(t("events").select(gaps.alias("value"), "event_type"))


WIDE = """
WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)
SELECT 'e' || a.k AS x, 'e' || b.k AS y, round({f}(a.v::DOUBLE, b.v::DOUBLE), 6) + 0.0 AS r
FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.k {order} b.k GROUP BY a.k, b.k"""


def wide_columns(t):
    """Each of the 64 components of a vector as a column."""
    return t("embeddings").select(*[F.col("embedding")[k].cast("double").alias(f"e{k + 1}") for k in range(64)])


@query(WIDE.format(f="corr", order="<"))
def correlation_wide(t):
    return profile.correlation_pairs(wide_columns(t), [f"e{k + 1}" for k in range(64)])


@query(WIDE.format(f="covar_samp", order="<="))
def covariance_wide(t):
    return profile.covariance_pairs(wide_columns(t), [f"e{k + 1}" for k in range(64)])
