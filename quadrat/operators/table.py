"""Casts, filters, selections, joins and unions on whole tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quadrat.functions.columns import (
    categorical_names,
    is_missing,
    melt,
    numeric_names,
    require_columns,
)
from quadrat.operators.durable import small_side

CASTS = {
    "datetime": "timestamp_ntz",
    "category": "string",
    "number": "double",
    "integer": "bigint",
    "float_": "double",
    "string": "string",
    "boolean": "boolean",
}


def cast_columns(
    df: DataFrame,
    datetime: Sequence[str] = (),
    category: Sequence[str] = (),
    number: Sequence[str] = (),
    integer: Sequence[str] = (),
    float_: Sequence[str] = (),
    string: Sequence[str] = (),
    boolean: Sequence[str] = (),
    lenient: bool = False,
) -> DataFrame:
    """Re-type columns in one projection; a column in two lists ends with the later type.

    ``lenient`` turns unparsable values into NULL instead of raising. Category
    columns become strings that carry ``role=category`` metadata.
    """
    lists = {
        "datetime": datetime, "category": category, "number": number,
        "integer": integer, "float_": float_, "string": string, "boolean": boolean,
    }
    wanted: dict[str, str] = {}
    for kind, names in lists.items():
        require_columns(df, list(names or ()))
        wanted.update(dict.fromkeys(names or (), kind))

    def typed(name: str) -> Column:
        if name not in wanted:
            return F.col(name)
        column, kind = F.col(name), wanted[name]
        if kind == "boolean" and not isinstance(df.schema[name].dataType, T.BooleanType):
            column = column.try_cast("bigint") if lenient else column.cast("bigint")
        cast = column.try_cast(CASTS[kind]) if lenient else column.cast(CASTS[kind])
        return cast.alias(name, metadata={"role": "category"} if kind == "category" else {})

    return df.select(*[typed(name) for name in df.columns])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns; an unknown name is an error."""
    require_columns(df, names)
    return df.drop(*names)


def keep_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the listed columns in schema order."""
    require_columns(df, names)
    return df.select(*[c for c in df.columns if c in set(names)])


def drop_duplicate_names(df: DataFrame) -> DataFrame:
    """Keep the first of several columns that share a name."""
    unique = [f"{name}__{i}" for i, name in enumerate(df.columns)]
    first: dict[str, str] = {}
    for name, alias in zip(df.columns, unique, strict=True):
        first.setdefault(name, alias)
    return df.toDF(*unique).select(*[F.col(a).alias(n) for n, a in first.items()])


def drop_rows_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Remove rows equal to ``value``; NULLs stay."""
    require_columns(df, [column])
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|[\w.]+|<=>|!=|<>|<=|>=|==|\|\||\s+|.", re.DOTALL)
#: Tokens that end an operand of a comparison: looser operators and clause words.
_LOOSER = frozenset("AND OR NOT WHEN THEN ELSE CASE END IS IN BETWEEN LIKE ILIKE RLIKE , = == < > <= >= <=> != <>".split())


def _operand_end(tokens: list[str], at: int, step: int) -> int:
    """Last token of the operand that starts next to the comparison at ``at``."""
    inner, outer = ("([", ")]") if step > 0 else (")]", "([")
    depth, last, k = 0, at, at + step
    while 0 <= k < len(tokens):
        token = tokens[k]
        if not depth and (token in outer or token.upper() in _LOOSER):
            break
        depth += (token in inner) - (token in outer)
        last = last if token.isspace() else k
        k += step
    return last


def _null_safe(expression: str) -> str:
    """``a != b`` as ``NOT (a <=> b)``; the operands reach up to the next looser operator."""
    tokens = _TOKEN.findall(expression)
    before, after = [""] * len(tokens), [""] * len(tokens)
    for k, token in enumerate(tokens):
        if token in ("!=", "<>"):
            before[_operand_end(tokens, k, -1)] += "(NOT (("
            after[_operand_end(tokens, k, 1)] += ")))"
            tokens[k] = ") <=> ("
    return "".join(b + t + a for b, t, a in zip(before, tokens, after))


def filter_rows(df: DataFrame, expression: str, keep_nulls: bool = True) -> DataFrame:
    """Filter by a boolean expression.

    With ``keep_nulls``, ``a != b`` also holds where one side is NULL, as in a
    data frame comparison.
    """
    if keep_nulls:
        expression = _null_safe(expression)
    return df.filter(F.expr(expression))


def shape(df: DataFrame) -> DataFrame:
    """One row ``(rows, columns)``."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns")
    )


def select_numeric(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numeric columns and their names."""
    names = numeric_names(df)
    return df.select(*names), names


def select_categorical(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Category columns and their names."""
    names = categorical_names(df)
    return df.select(*names), names


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values including NULL."""
    return df.select(column).distinct()


def columns_with_nulls(df: DataFrame) -> DataFrame:
    """``(ordinal, column, missing)`` for every column that has a missing value."""
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(name).alias("column"),
                F.count_if(is_missing(df, name)).alias("missing"),
            )
            for i, name in enumerate(df.columns)
        ]
    )
    return df.agg(cells.alias("__c")).select(F.inline("__c")).filter("missing > 0")


def records_to_table(spark: SparkSession, record: Mapping[str, float]) -> DataFrame:
    """A record as rows ``(key, value)``."""
    rows = [(str(k), float(v)) for k, v in record.items()]
    return spark.createDataFrame(rows, "key string, value double")


def column_to_array(df: DataFrame, column: str) -> DataFrame:
    """A one-column double table: the distributed form of a numeric array."""
    return df.select(F.col(column).cast("double").alias("value"))


def array_to_rows(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """``(keys…, position, value)``: one row per array element."""
    return df.select(*keys, F.posexplode(column).alias("position", "value"))


def label_map(df: DataFrame, column: str) -> DataFrame:
    """``(label, code)`` with codes 0… in ascending label order.

    The window runs over the distinct labels, not over the rows.
    """
    labels = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    return labels.select(
        "label", (F.row_number().over(W.orderBy("label")) - 1).cast("int").alias("code")
    )


def encode_labels(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Add the integer code of a label column (sorted ascending); NULL has none."""
    codes = label_map(df, column).withColumnsRenamed({"label": "__label", "code": name})
    codes = small_side(codes)
    return df.join(codes, F.col(column) == F.col("__label"), "left").drop("__label")


def decode_labels(df: DataFrame, codes: DataFrame, code: str, name: str) -> DataFrame:
    """Look labels up from their codes (the inverse of :func:`encode_labels`)."""
    table = small_side(codes.select(F.col("code").alias("__code"), F.col("label").alias(name)))
    return df.join(table, F.col(code) == F.col("__code"), "left").drop("__code")


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def attach_categories(
    outliers: DataFrame, df: DataFrame, categories: Sequence[str], key: str
) -> DataFrame:
    """Right equi-join: every outlier row kept, its category columns added."""
    return df.select(key, *categories).join(outliers, key, "right")


def remove_rows_by_key(
    df: DataFrame, rows: DataFrame, key: str | Sequence[str], drop: Sequence[str] = ()
) -> DataFrame:
    """Anti-join on the key, then drop helper columns."""
    keys = [key] if isinstance(key, str) else list(key)
    return drop_columns(df.join(rows.select(*keys), keys, "left_anti"), drop)


def concat_columns(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Align tables side by side on a unique key (full outer); repeated keys raise."""

    def checked(table: DataFrame, index: int) -> DataFrame:
        others = [c for c in table.columns if c != key]
        grouped = table.groupBy(key).agg(
            F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in others]
        )
        once = F.when(F.col("__n") == 1, F.col(key)).otherwise(
            F.raise_error(F.lit(f"table {index} repeats a key")).cast(table.schema[key].dataType)
        )
        return grouped.select(once.alias(key), *others)

    parts = [checked(table, i) for i, table in enumerate(tables)]
    return reduce(lambda a, b: a.join(b, key, "full"), parts)


def flag_overlap(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of ``first`` that ``second`` flags too."""
    return first.join(second.select(key), key, "left_semi")


def consensus_outliers(tables: Sequence[DataFrame], key: str, min_methods: int = 2) -> DataFrame:
    """``(key, feature, methods)`` flagged by at least ``min_methods`` methods.

    Every table has ``(key, feature, method)``.
    """
    rows = reduce(DataFrame.unionByName, [t.select(key, "feature", "method") for t in tables])
    return (
        rows.groupBy(key, "feature")
        .agg(F.count_distinct("method").alias("methods"))
        .filter(F.col("methods") >= min_methods)
    )


def concat_rows(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; missing columns become NULL and repeats are kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Distinct rows; NULL equals NULL."""
    return df.dropDuplicates()


def match_names(stems: DataFrame, stem: str, names: DataFrame, name: str) -> DataFrame:
    """``(name, stem)`` for every stem that contains the name.

    An equi-join, not a comparison of all pairs: each stem emits its distinct
    substrings of the lengths that occur among the names, so the work grows with
    the text and with the matches.
    """
    wanted = names.select(F.col(name).alias("name")).filter("length(name) > 0").distinct()
    lengths = wanted.agg(F.collect_set(F.length("name"))).scalar()
    text = stems.select(F.col(stem).alias("stem")).filter("stem is not null").distinct()
    text = text.select("stem", lengths.alias("lengths"))

    def pieces(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length("stem") - size + 1)
        cut = F.transform(starts, lambda at: F.substring(F.col("stem"), at, size))
        return F.when(F.length("stem") >= size, cut).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.flatten(F.transform("lengths", pieces)))
    return text.select("stem", F.explode(grams).alias("name")).join(small_side(wanted), "name")


def match_files(stems: DataFrame, stem: str, names: DataFrame, name: str) -> DataFrame:
    """``(name, files, matched)``: how many stems contain each wanted partial name."""
    found = match_names(stems, stem, names, name).groupBy("name").agg(
        F.count(F.lit(1)).alias("files")
    )
    wanted = names.select(F.col(name).alias("name")).distinct()
    files = F.coalesce(F.col("files"), F.lit(0)).cast("bigint")
    return wanted.join(found, "name", "left").select(
        "name", files.alias("files"), (files > 0).alias("matched")
    )


def heatmap_long(matrix: DataFrame, row: str) -> DataFrame:
    """A matrix as ``(row, column, value)``."""
    names = [c for c in matrix.columns if c != row]
    return melt(matrix, names, [row]).select(
        F.col(row).alias("row"), F.col("feature").alias("column"), "value"
    )
