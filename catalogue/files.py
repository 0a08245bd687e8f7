"""Registered queries: what is written can be read again; listings; stored models."""

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue.registry import query
from catalogue.tables import GAPS, with_gaps
from quadrat.operators import table
from quadrat.operators.durable import checkpoint_folder
from quadrat.sources import files

ORDERS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def scratch(df) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_folder(df.sparkSession).rstrip('/')}/files-{uuid.uuid4().hex}"


@query(f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day,
  {GAPS} AS o_orderpriority FROM orders""", digits=2)
def csv_round_trip(t):
    rows = with_gaps(t("orders"))
    path = scratch(rows)
    files.write_csv(rows, path, key="o_custkey")
    schema = T.StructType([rows.schema["o_custkey"], *[f for f in rows.schema if f.name != "o_custkey"]])
    again = files.read_csv(rows.sparkSession, path, schema, key="o_orderkey")
    return again.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumnRenamed("o_orderdate", "day")


@query(f"""
SELECT o_orderkey, o_orderstatus, o_totalprice, {GAPS} AS o_orderpriority FROM orders""", digits=2)
def delimited_round_trip(t):
    # fields end in ";", "," or ";" and carry blanks; gaps are blank fields
    rows = with_gaps(t("orders"))
    line = F.concat(
        F.col("o_orderkey").cast("string"), F.lit("; "), F.col("o_orderstatus"), F.lit(" , "),
        F.coalesce("o_orderpriority", F.lit(" ")), F.lit(";"), F.col("o_totalprice").cast("string"),
    )
    path = scratch(rows)
    rows.select(line.alias("value")).write.text(path)
    schema = "o_orderkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double"
    return files.read_delimited(rows.sparkSession, path, T.StructType.fromDDL(schema), header=False)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders", digits=2)
def table_round_trip(t):
    rows = t("orders").select(*ORDERS)
    path = scratch(rows)
    files.write_table(rows, path, ["o_orderpriority"])
    return files.read_table(rows.sparkSession, path)


def in_folders(t):
    """The orders, one file in a folder per priority."""
    rows = t("orders").select(*ORDERS)
    path = scratch(rows)
    files.write_table(rows.repartition("o_orderpriority"), path, ["o_orderpriority"])
    return rows.sparkSession, path


@query("""
SELECT 'o_orderpriority=' || o_orderpriority AS folder, CAST(1 AS BIGINT) AS files, true AS named, true AS filled
FROM orders GROUP BY ALL""")
def list_files(t):
    found = files.list_files(*in_folders(t), ".parquet")
    whole = F.concat("folder", F.lit("/"), "stem", F.lit(".parquet")) == F.col("path")
    return found.groupBy(F.regexp_extract("folder", "[^/]*$", 0).alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.bool_and(whole).alias("named"), F.bool_and(F.col("length") > 0).alias("filled")
    )


@query("SELECT DISTINCT 'o_orderpriority=' || o_orderpriority AS folder FROM orders")
def list_folders(t):
    # the success marker makes the top folder one with files
    found = files.list_folders(*in_folders(t)).select(F.regexp_extract("folder", "[^/]*$", 0).alias("folder"))
    return found.filter(F.col("folder").contains("="))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_quantity - a) / b, 6) + 0.0 AS z
FROM lineitem, (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS b FROM lineitem)""")
def model_round_trip(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    steps = [
        VectorAssembler(inputCols=["l_quantity"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
    ]
    path = scratch(rows)
    files.save_model(Pipeline(stages=steps).fit(rows), path)
    scaled = files.load_model(path).transform(rows)
    return scaled.withColumn("z", vector_to_array("scaled")[0]).drop("raw", "scaled", "l_quantity")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def drop_duplicate_names(t):
    rows = t("orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("o_custkey"), "o_orderstatus",
        F.col("o_orderdate").alias("o_orderkey"),
    )
    return table.drop_duplicate_names(rows)
