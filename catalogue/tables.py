"""Registered queries: casts, filters, joins, unions and array functions."""

from pyspark.sql import functions as F

from catalogue.registry import query
from quadrat.functions import arrays, columns
from quadrat.operators import outliers, table

GAPS = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END"


def with_gaps(orders):
    """Orders whose priority is missing for every seventh key."""
    return orders.withColumn("o_orderpriority", F.expr(GAPS))


@query("""
SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') AS day,
       CAST(trunc(o_totalprice) AS BIGINT) AS price, CAST(o_custkey AS VARCHAR) AS customer,
       CAST(o_orderkey AS DOUBLE) AS key_number, o_orderstatus AS status
FROM orders""")
def cast_columns(t):
    wide = t("orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderkey").cast("string").alias("key_number"),
        F.col("o_orderstatus").alias("status"),
    )
    typed = table.cast_columns(
        wide, datetime=["day"], category=["status"], number=["key_number"],
        integer=["price"], string=["customer"],
    )
    return typed.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders", digits=2)
def drop_columns(t):
    return table.drop_columns(t("orders"), ["o_orderdate", "o_orderpriority"])


@query("SELECT c_custkey, c_acctbal FROM customer", digits=2)
def keep_features(t):
    return table.keep_features(t("customer"), ["c_acctbal", "c_custkey"])


@query(f"""
SELECT o_orderkey, p AS o_orderpriority FROM (SELECT o_orderkey, {GAPS} AS p FROM orders)
WHERE p IS DISTINCT FROM '1-URGENT'""")
def drop_rows_equal(t):
    rows = with_gaps(t("orders")).select("o_orderkey", "o_orderpriority")
    return table.drop_rows_equal(rows, "o_orderpriority", "1-URGENT")


@query(f"""
SELECT o_orderkey, p AS o_orderpriority, o_totalprice
FROM (SELECT o_orderkey, {GAPS} AS p, o_totalprice FROM orders)
WHERE (p IS NULL OR p <> '5-LOW') AND o_totalprice > 100000""", digits=2)
def filter_rows(t):
    rows = with_gaps(t("orders")).select("o_orderkey", "o_orderpriority", "o_totalprice")
    return table.filter_rows(rows, "o_orderpriority != '5-LOW' and o_totalprice > 100000")


@query(f"""
SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, {GAPS} AS p FROM orders)
WHERE upper(p) IS DISTINCT FROM '1-URGENT' AND (o_orderkey % 5 <> 1 OR p IS DISTINCT FROM '5-LOW')""")
def filter_rows_expressions(t):
    condition = "upper(o_orderpriority) != concat('1-', 'URGENT') and (o_orderkey % 5 != 1 or o_orderpriority <> '5-LOW')"
    return table.filter_rows(with_gaps(t("orders")), condition).select("o_orderkey")


@query("SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def shape(t):
    return table.shape(t("lineitem"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders", digits=2)
def select_numeric(t):
    return table.select_numeric(t("orders"))[0]


@query("SELECT p_name, p_brand, p_type FROM part")
def select_categorical(t):
    return table.select_categorical(t("part"))[0]


@query("""
SELECT c_custkey, substring(regexp_split_to_array(c_name, '_+')[1], 9, 8) AS middle,
       substring(regexp_split_to_array(c_name, '_+')[1], 14) AS tail,
       substring(regexp_split_to_array(replace(c_name, '#', '__'), '_+')[1], 1, 8) AS head
FROM customer""")
def extract_key(t):
    return t("customer").select(
        "c_custkey",
        columns.extract_key("c_name", 8, 16).alias("middle"),
        columns.extract_key("c_name", 13).alias("tail"),
        columns.extract_key(F.replace("c_name", F.lit("#"), F.lit("__")), 0, 8).alias("head"),
    )


@query("""
SELECT DISTINCT p_name, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], ' ') AS label FROM part""")
def pretty_label(t):
    names = t("part").select("p_name").distinct()
    underscored = F.replace("p_name", F.lit(" "), F.lit("_"))
    return names.select("p_name", columns.pretty_label(underscored).alias("label"))


@query(f"SELECT DISTINCT {GAPS} AS o_orderpriority FROM orders")
def distinct_values(t):
    return table.distinct_values(with_gaps(t("orders")), "o_orderpriority")


@query(f"""
SELECT CAST(5 AS INTEGER) AS ordinal, 'o_orderpriority' AS "column",
       count(*) FILTER ({GAPS} IS NULL) AS missing FROM orders""")
def columns_with_nulls(t):
    return table.columns_with_nulls(with_gaps(t("orders")))


@query("""
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS position,
       round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS value FROM embeddings""")
def array_to_rows(t):
    rows = table.array_to_rows(t("embeddings"), "embedding", ["vec_id"])
    return rows.withColumn("value", F.col("value").cast("double"))


@query("SELECT CAST(o_custkey AS DOUBLE) AS value FROM orders")
def column_to_array(t):
    return table.column_to_array(t("orders"), "o_custkey")


@query("""
SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code
FROM events""")
def encode_labels(t):
    return table.encode_labels(t("events").select("event_id", "event_type"), "event_type")


@query("SELECT event_id, event_type AS label FROM events")
def decode_labels(t):
    rows = t("events").select("event_id", "event_type")
    coded = table.encode_labels(rows, "event_type").drop("event_type")
    codes = table.label_map(rows, "event_type")
    return table.decode_labels(coded, codes, "code", "label").select("event_id", "label")


@query("""
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT p_brand AS label FROM part)""")
def label_map(t):
    return table.label_map(t("part"), "p_brand")


VECTOR = "CAST(embedding AS DOUBLE[])"
MEAN = "(list_sum(v) / len(v))"


def half_even(value: str) -> str:
    """Banker's rounding to three digits in SQL."""
    return f"round_even({value}, 3) + 0.0"


@query(f"SELECT vec_id, {half_even(MEAN)} AS mean FROM (SELECT vec_id, {VECTOR} AS v FROM embeddings)")
def array_mean(t):
    return t("embeddings").select("vec_id", arrays.array_mean("embedding").alias("mean"))


@query(f"""
SELECT vec_id, {half_even("list_median(v)")} AS median
FROM (SELECT vec_id, {VECTOR} AS v FROM embeddings)""")
def array_median(t):
    return t("embeddings").select("vec_id", arrays.array_median("embedding").alias("median"))


@query(f"""
SELECT vec_id, {half_even("list_stddev_pop(v)")} AS std
FROM (SELECT vec_id, {VECTOR} AS v FROM embeddings)""")
def array_std(t):
    return t("embeddings").select("vec_id", arrays.array_std("embedding").alias("std"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       round(list_stddev_pop([l_quantity, l_discount, l_tax]), 6) + 0.0 AS spread FROM lineitem""")
def row_std(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    spread = arrays.row_std(["l_quantity", "l_discount", "l_tax"])
    return t("lineitem").select(*keys, spread.alias("spread"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS length FROM embeddings")
def array_length(t):
    return t("embeddings").select("vec_id", arrays.array_length("embedding").alias("length"))


@query("SELECT count(*) AS rows FROM events")
def row_count(t):
    return table.row_count(t("events"))


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS value, o_orderstatus, o_orderpriority FROM orders, q
WHERE o_totalprice > b + 0.4 * (b - a) OR o_totalprice < a - 0.4 * (b - a)""", digits=2)
def attach_categories(t):
    rows = t("orders")
    found = outliers.iqr_outliers(rows, "o_totalprice", "o_orderkey", k=0.4)
    return table.attach_categories(found, rows, ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM orders, q
WHERE o_totalprice BETWEEN a - 0.4 * (b - a) AND b + 0.4 * (b - a)""", digits=2)
def remove_rows_by_key(t):
    rows = t("orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("score"))
    found = outliers.iqr_outliers(rows, "o_totalprice", "o_orderkey", k=0.4)
    return table.remove_rows_by_key(rows, found, "o_orderkey", drop=["score"])


@query("""
SELECT coalesce(a.k, b.k, c.k) AS k, c_acctbal, p_retailprice, s_acctbal
FROM (SELECT c_custkey AS k, c_acctbal FROM customer) a
FULL JOIN (SELECT p_partkey AS k, p_retailprice FROM part) b ON a.k = b.k
FULL JOIN (SELECT s_suppkey AS k, s_acctbal FROM supplier) c ON coalesce(a.k, b.k) = c.k""", digits=2)
def concat_columns(t):
    return table.concat_columns(
        [
            t("customer").select(F.col("c_custkey").alias("k"), "c_acctbal"),
            t("part").select(F.col("p_partkey").alias("k"), "p_retailprice"),
            t("supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal"),
        ],
        "k",
    )


@query("""
SELECT doc_id, 'document' AS kind, lang, n_chars, NULL AS role FROM documents
UNION ALL SELECT conv_id, 'conversation', NULL, NULL, role FROM conversations""")
def concat_rows(t):
    first = t("documents").select("doc_id", F.lit("document").alias("kind"), "lang", "n_chars")
    second = t("conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit("conversation").alias("kind"), "role"
    )
    return table.concat_rows([first, second])


@query("""
SELECT DISTINCT l_returnflag, l_linestatus, l_discount,
       CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem""")
def drop_duplicate_rows(t):
    tax = F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax")
    return table.drop_duplicate_rows(
        t("lineitem").select("l_returnflag", "l_linestatus", "l_discount", tax)
    )


WORDS = "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS name FROM part UNION SELECT DISTINCT p_name[1:3] FROM part"


def wanted_words(t):
    """Words of the part types and the first three letters of the part names."""
    words = t("part").select(F.explode(F.split("p_type", " ")).alias("name"))
    starts = t("part").select(F.substring("p_name", 1, 3).alias("name"))
    return words.unionAll(starts).distinct()


@query(f"""
WITH names AS ({WORDS}), stems AS (SELECT DISTINCT p_name AS stem FROM part)
SELECT name, stem FROM names JOIN stems ON contains(stem, name)""")
def match_names(t):
    return table.match_names(t("part"), "p_name", wanted_words(t), "name")


@query(f"""
WITH names AS ({WORDS}), stems AS (SELECT DISTINCT p_name AS stem FROM part)
SELECT name, count(stem) AS files, count(stem) > 0 AS matched
FROM names LEFT JOIN stems ON contains(stem, name) GROUP BY name""")
def match_files(t):
    return table.match_files(t("part"), "p_name", wanted_words(t), "name")


@query("""
SELECT l_returnflag AS "row", 'l_discount' AS "column", round(avg(l_discount), 6) + 0.0 AS value
FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, 'l_tax', round(avg(l_tax), 6) + 0.0 FROM lineitem GROUP BY l_returnflag""")
def heatmap_long(t):
    means = t("lineitem").groupBy("l_returnflag").agg(
        F.avg("l_discount").alias("l_discount"), F.avg("l_tax").alias("l_tax")
    )
    return table.heatmap_long(means, "l_returnflag")
