"""Registered queries: principal components and the tables behind charts."""

from pyspark.sql import functions as F

from catalogue.outliers import KEYS
from catalogue.profiles import LINE, t_bound
from catalogue.registry import query
from quadrat.operators import charts, multivariate

PAIR = ["l_quantity", "l_extendedprice"]
R = "(SELECT corr(l_quantity, l_extendedprice) AS r, CAST(count(*) AS DOUBLE) AS n FROM lineitem)"


@query(f"""
SELECT unnest([1, 2]) AS axis, unnest(['pc1', 'pc2']) AS pc,
  unnest([round((1 + abs(r)) * n / (n - 1), 6), round((1 - abs(r)) * n / (n - 1), 6)]) + 0.0 AS eigenvalue,
  unnest([round(50 * (1 + abs(r)), 6), round(50 * (1 - abs(r)), 6)]) + 0.0 AS percent,
  unnest([round(50 * (1 + abs(r)), 6), 100.0]) + 0.0 AS cumulated FROM {R}""")
def pca_variance(t):
    rows = t("lineitem")
    return multivariate.pca_variance(rows.sparkSession, multivariate.pca_fit(rows, PAIR, 2))


@query("""
WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS b,
  stddev_pop(l_extendedprice) AS sb, sign(corr(l_quantity, l_extendedprice)) AS r FROM lineitem),
z AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_quantity - a) / sa AS u, (l_extendedprice - b) / sb AS v, r FROM lineitem, s)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(abs(u + r * v) / sqrt(2), 5) + 0.0 AS pc1,
  round(abs(u - r * v) / sqrt(2), 5) + 0.0 AS pc2 FROM z""", digits=5)
def pca_scores(t):
    # two equal loadings leave the sign open: compare sizes
    rows = t("lineitem")
    scores = multivariate.pca_scores(rows, multivariate.pca_fit(rows, PAIR, 2))
    return scores.select(*KEYS, F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2"))


@query()
def pca_loadings(t):
    rows = t("lineitem")
    return multivariate.pca_loadings(rows.sparkSession, multivariate.pca_fit(rows, LINE, 0.95))


@query()
def pca_analysis(t):
    return multivariate.pca_analysis(t("lineitem"), LINE, KEYS)["scores"]


@query()
def scree(t):
    return multivariate.pca_analysis(t("lineitem"), LINE)["best_axes"]


@query()
def pca_outliers(t):
    return multivariate.pca_outliers(t("lineitem"), LINE, KEYS)


@query("""
SELECT l_returnflag AS class, count(*) AS n, round(avg(l_quantity), 6) + 0.0 AS center_x, round(avg(l_discount), 6) + 0.0 AS center_y,
  round(var_samp(l_quantity), 6) + 0.0 AS var_x, round(var_samp(l_discount), 6) + 0.0 AS var_y FROM lineitem GROUP BY 1""")
def class_ellipses(t):
    rows = multivariate.class_ellipses(t("lineitem"), "l_quantity", "l_discount", "l_returnflag")
    return rows.drop("half_x", "half_y")


@query(f"""
SELECT l_returnflag AS class, n, round(a, 6) + 0.0 AS center_x, round(b, 6) + 0.0 AS center_y, round(va, 6) + 0.0 AS var_x,
  round(vb, 6) + 0.0 AS var_y, round({t_bound("n")} * sqrt(va), 6) + 0.0 AS half_x, round({t_bound("n")} * sqrt(vb), 6) + 0.0 AS half_y
FROM (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS a, avg(l_discount) AS b, var_samp(l_quantity) AS va,
  var_samp(l_discount) AS vb FROM lineitem GROUP BY 1)""")
def class_ellipse_axes(t):
    return multivariate.class_ellipses(t("lineitem"), "l_quantity", "l_discount", "l_returnflag")


@query("""
WITH m AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 20.0 AS w FROM customer)
SELECT c_mktsegment, CAST(least(floor((c_acctbal - lo) / w), 19) AS BIGINT) AS bin, count(*) AS n,
  round(lo + w * least(floor((c_acctbal - lo) / w), 19), 4) + 0.0 AS bin_lo,
  round(lo + w * least(floor((c_acctbal - lo) / w), 19) + w, 4) + 0.0 AS bin_hi
FROM customer, m GROUP BY ALL""", digits=4)
def histogram(t):
    return charts.histogram(t("customer"), "c_acctbal", hue="c_mktsegment")


@query("""
WITH s AS (SELECT event_type AS hue, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo,
  max(value) AS hi, skewness(value) AS skew FROM events GROUP BY 1),
p AS (SELECT hue, round((value - lo) / ((hi - lo) / 999.0)) AS i, count(*) AS w FROM events JOIN s ON event_type = hue GROUP BY 1, 2),
g AS (SELECT *, lo - 3 * h + g * ((hi - lo + 6 * h) / 199.0) AS x FROM s, (SELECT unnest(range(0, 200)) AS g))
SELECT g.hue, round(x, 6) + 0.0 AS x, round(skew, 6) + 0.0 AS skew,
  round(sum(w * exp(-0.5 * pow((x - (lo + i * ((hi - lo) / 999.0))) / h, 2)) / sqrt(2 * pi()) / (n * h)), 6) + 0.0 AS density
FROM g JOIN p ON g.hue = p.hue GROUP BY g.hue, g, x, skew""")
def kde(t):
    return charts.kde(t("events"), "value", "event_type")


@query("""
WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median,
  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderstatus, round(q1, 4) + 0.0 AS q1, round(median, 4) + 0.0 AS median, round(q3, 4) + 0.0 AS q3,
  round(min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1)), 4) + 0.0 AS whisker_low,
  round(max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1)), 4) + 0.0 AS whisker_high,
  count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS fliers
FROM orders JOIN q USING (o_orderstatus) GROUP BY ALL""", digits=4)
def box_stats(t):
    return charts.box_stats(t("orders"), "o_totalprice", ["o_orderstatus"])


@query("""
WITH q AS (SELECT l_linestatus, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS median,
  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l_linestatus, round(q1, 4) + 0.0 AS q1, round(median, 4) + 0.0 AS median, round(q3, 4) + 0.0 AS q3,
  round(min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1)), 4) + 0.0 AS whisker_low,
  round(max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5 * (q3 - q1)), 4) + 0.0 AS whisker_high,
  count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS fliers
FROM lineitem JOIN q USING (l_linestatus) GROUP BY ALL""", digits=4)
def box_stats_lineitem(t):
    """Groups large enough to be bracketed by sketches."""
    return charts.box_stats(t("lineitem"), "l_extendedprice", ["l_linestatus"])


@query("""
SELECT event_type, 'value' AS feature, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY 1""")
def bar_means(t):
    rows = charts.bar_means(t("events"), "event_type", ["value"], keys=["event_id"])
    return rows.select("event_type", "feature", "mean")


@query()
def bar_means_bootstrap(t):
    return charts.bar_means(t("events"), "event_type", ["value"], keys=["event_id"])


@query("""
SELECT l_linenumber, count(*) AS n, round(avg(l_extendedprice), 4) + 0.0 AS mean FROM lineitem GROUP BY 1""", digits=4)
def line_means(t):
    return charts.line_means(t("lineitem"), "l_linenumber", "l_extendedprice").drop("low", "high")


@query(f"""
SELECT l_linenumber, n, round(m, 4) + 0.0 AS mean, round(m - {t_bound("n")} * s / sqrt(n), 4) + 0.0 AS low,
  round(m + {t_bound("n")} * s / sqrt(n), 4) + 0.0 AS high
FROM (SELECT l_linenumber, count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1)""", digits=4)
def line_means_bounds(t):
    return charts.line_means(t("lineitem"), "l_linenumber", "l_extendedprice")


@query(" UNION ALL ".join(f"""
SELECT l_returnflag, '{a}' AS x, '{b}' AS y, round(regr_slope({b}, {a}), 4) + 0.0 AS slope,
  round(regr_intercept({b}, {a}), 4) + 0.0 AS intercept, round(regr_r2({b}, {a}), 4) + 0.0 AS r2, CAST(regr_count({b}, {a}) AS BIGINT) AS n
FROM lineitem GROUP BY 1""" for a, b in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax")]), digits=4)
def pair_regressions(t):
    return charts.pair_regressions(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "l_returnflag")


@query()
def qq_points(t):
    return charts.qq_points(t("supplier"), "s_acctbal")


@query()
def qq_points_thinned(t):
    return charts.qq_points(t("orders"), "o_totalprice", points=20)


@query("""
WITH m AS (SELECT min(l_quantity) AS ax, max(l_quantity) AS bx, min(l_extendedprice) AS ay, max(l_extendedprice) AS b FROM lineitem)
SELECT l_returnflag, CAST(least(floor((l_quantity - ax) / (bx - ax) * 50), 49) AS INTEGER) AS bin_x,
  CAST(least(floor((l_extendedprice - ay) / (b - ay) * 50), 49) AS INTEGER) AS bin_y, count(*) AS n
FROM lineitem, m GROUP BY 1, 2, 3""")
def scatter_bins(t):
    return charts.scatter_bins(t("lineitem"), "l_quantity", "l_extendedprice", hue="l_returnflag")


@query("""
SELECT event_id, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type
  ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), '42'))) AS i FROM events) WHERE i <= 100""", digits=4)
def scatter_sample(t):
    return charts.scatter_sample(t("events"), ["event_id"], ["value"], 100, "event_type")


@query()
def scatter_pairs(t):
    rows = t("lineitem")
    model = multivariate.pca_fit(rows, LINE, 3)
    shares = [float(100 * v / model.total) for v in model.eigenvalues]
    return charts.scatter_pairs(multivariate.pca_scores(rows, model), ["pc1", "pc2", "pc3"], shares)
