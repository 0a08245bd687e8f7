"""Registered queries: feature preparation and selection."""

from pyspark.sql import functions as F

from catalogue.profiles import LINE
from catalogue.registry import query
from catalogue.tables import with_gaps
from quadrat.operators import features

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEY_LIST = ", ".join(KEYS)


def scaled_sql(centre: str, scale: str) -> str:
    """Quantity and tax after scaling."""
    def stat(part, c):
        return part.format(c=c)
    return f"""
WITH s AS (SELECT {stat(centre, 'l_quantity')} AS c1, {stat(scale, 'l_quantity')} AS s1,
  {stat(centre, 'l_tax')} AS c2, {stat(scale, 'l_tax')} AS s2 FROM lineitem)
SELECT {KEY_LIST}, round((l_quantity - c1) / s1, 6) + 0.0 AS l_quantity, round((l_tax - c2) / s2, 6) + 0.0 AS l_tax
FROM lineitem, s"""


@query(scaled_sql("avg({c})", "stddev_pop({c})"))
def standardise(t):
    return features.standardise(t("lineitem").select(*KEYS, "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


@query(scaled_sql("min({c})", "(max({c}) - min({c}))"))
def minmax_scale(t):
    return features.minmax_scale(t("lineitem").select(*KEYS, "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


@query(scaled_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def robust_scale(t):
    return features.robust_scale(t("lineitem").select(*KEYS, "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


@query(digits=4)
def power_transform(t):
    return features.power_transform(t("events").select("event_id", "value"), ["value"])


@query("""
WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer)
SELECT c_custkey, round(coalesce(b, (SELECT median(b) FROM g)), 4) + 0.0 AS c_acctbal FROM g""", digits=4)
def impute_median(t):
    gaps = t("customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal")
    )
    return features.impute_median(gaps, ["c_acctbal"])


@query("""
WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders),
top AS (SELECT p FROM g WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
SELECT o_orderkey, coalesce(g.p, top.p) AS o_orderpriority FROM g, top""")
def impute_mode(t):
    rows = with_gaps(t("orders")).select("o_orderkey", "o_orderpriority")
    return features.impute_mode(rows, ["o_orderpriority"])


@query("""
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O,
  CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""")
def one_hot(t):
    return features.one_hot(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("""
WITH c AS (SELECT o_orderpriority AS p, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'))
SELECT o_orderkey, coalesce(code, -1) AS o_orderpriority FROM orders LEFT JOIN c ON o_orderpriority = p""")
def ordinal_encode(t):
    rows = t("orders").select("o_orderkey", "o_orderpriority")
    seen = features.label_map(rows.filter("o_orderpriority <> '5-LOW'"), "o_orderpriority")
    return features.ordinal_encode(rows, "o_orderpriority", seen)


def gappy_events(t):
    """Events with two derived columns that are mostly missing."""
    return t("events").select(
        "event_id",
        "value",
        F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("rare"),
        F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("third"),
    )


@query("""
SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN value END AS third FROM events""", digits=4)
def drop_sparse_features(t):
    return features.drop_sparse_features(gappy_events(t), ["value", "rare", "third"], 0.7)


@query("""
SELECT event_id, value, CASE WHEN event_id % 10 = 0 THEN value END AS rare,
  CASE WHEN event_id % 3 = 0 THEN value END AS third FROM events WHERE event_id % 10 = 0 OR event_id % 3 = 0""", digits=4)
def drop_sparse_rows(t):
    return features.drop_sparse_rows(gappy_events(t), ["value", "rare", "third"], 0.03)


@query("""
SELECT event_id, value, event_type FROM events""", digits=4)
def drop_constant_features(t):
    rows = t("events").select(
        "event_id", "value", "event_type",
        F.when(F.col("event_id") % 50 == 0, "b").otherwise("a").alias("nearly"),
        F.lit(7).alias("always"),
    )
    return features.drop_constant_features(rows, ["value", "event_type", "nearly", "always"])


@query("SELECT l_orderkey, l_quantity, l_tax FROM lineitem", digits=4)
def drop_duplicate_features(t):
    rows = t("lineitem").select(
        "l_orderkey", "l_quantity", F.col("l_quantity").cast("int").alias("same"), "l_tax",
        F.col("l_tax").alias("tax_again"),
    )
    return features.drop_duplicate_features(rows, ["l_quantity", "same", "l_tax", "tax_again"])


def with_price(t):
    """Line items with columns derived from the price."""
    return t("lineitem").select(
        *KEYS, "l_extendedprice",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_tax",
        (F.col("l_tax") * -2).alias("tax_twice"),
    )


@query(f"SELECT {KEY_LIST}, l_extendedprice, l_tax FROM lineitem", digits=4)
def drop_correlated_features(t):
    return features.drop_correlated_features(
        with_price(t), ["l_extendedprice", "net", "l_tax", "tax_twice"], 0.8
    )


@query("""
WITH w AS (SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_tax, l_tax * -2 AS tax_twice FROM lineitem),
p AS (SELECT 'l_extendedprice' AS feature, abs(corr(l_extendedprice, net)) AS r FROM w
  UNION ALL SELECT 'l_extendedprice', abs(corr(l_extendedprice, l_tax)) FROM w
  UNION ALL SELECT 'l_extendedprice', abs(corr(l_extendedprice, tax_twice)) FROM w
  UNION ALL SELECT 'net', abs(corr(net, l_tax)) FROM w UNION ALL SELECT 'net', abs(corr(net, tax_twice)) FROM w
  UNION ALL SELECT 'l_tax', abs(corr(l_tax, tax_twice)) FROM w)
SELECT DISTINCT feature FROM p WHERE r > 0.8""")
def correlated_to_drop(t):
    return features.correlated_to_drop(with_price(t), ["l_extendedprice", "net", "l_tax", "tax_twice"])


@query(f"SELECT {KEY_LIST}, l_quantity, l_extendedprice FROM lineitem", digits=4)
def drop_low_variance(t):
    return features.drop_low_variance(t("lineitem").select(*KEYS, *LINE), LINE, 0.01)
