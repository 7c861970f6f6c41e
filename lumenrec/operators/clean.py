"""Cleaning a catalogue: dropping columns, sentinels, missing values, type inference, joins that keep keys honest.

Odd input: columns that are not there are not dropped; nulls stay null unless a
function fills them; an empty table gives an empty result, and its text columns
count as numbers, as all of their values cast; null keys match nothing and are no
repeats; of several rows that `lookup` could return it takes one of the least position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def drop_family(df: DataFrame, prefix: str, first: int, last: int) -> DataFrame:
    """Drop a generated family such as Score-1 to Score-10."""
    return df.drop(*(f"{prefix}{i}" for i in range(first, last + 1)))


def label_slice(df: DataFrame, first: str, last: str) -> list[str]:
    """The contiguous columns from one label to another; none if they stand the other way round."""
    a, b = df.columns.index(first), df.columns.index(last)
    return df.columns[a : b + 1]


def sentinel_to_null(df: DataFrame, sentinel: str = "Unknown") -> DataFrame:
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*(F.nullif(F.col(f"`{c}`"), F.lit(sentinel)).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns))


def fill_null(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.fillna({column: value})


def drop_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=columns)


def prefer(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """A column with the first where it is given, else the second."""
    return df.withColumn(name, F.coalesce(F.col(first), F.col(second)))


def uncastable(df: DataFrame) -> DataFrame:
    """column_name, n_bad: how many values of each text column do not cast to a number. One pass over the data."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column_name string, n_bad long")
    bad = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(c) for c in texts]
    pairs = ", ".join(f"'{c}', `{c}`" for c in texts)
    return df.agg(*bad).selectExpr(f"stack({len(texts)}, {pairs}) as (column_name, n_bad)")


def infer_numeric(df: DataFrame) -> DataFrame:
    """Cast to double every text column all of whose values cast."""
    numeric = {r.column_name for r in uncastable(df).filter("n_bad = 0").collect()}
    return df.select(*(F.col(f"`{c}`").try_cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns))


def column_classes(df: DataFrame, key: str, excluded: set[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns by type, without the key and the excluded ones."""
    rest = [f for f in df.schema.fields if f.name != key and f.name not in excluded]
    numeric = [f.name for f in rest if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in rest if f.name not in numeric]


def join_inner(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "inner")


def join_left(left: DataFrame, right: DataFrame, on: str, unique: bool = True) -> DataFrame:
    """Left join; a right side with repeated keys would add rows, so `unique` makes it an error."""
    if unique:
        twice = right.filter(F.col(on).isNotNull()).groupBy(on).count().filter("count > 1").select(on).first()
        if twice:
            raise ValueError(f"{on} {twice[0]} is not unique on the right side")
    return left.join(right, on, "left")


def lookup(df: DataFrame, column: str, value: object, position: str) -> DataFrame:
    """The row of the least position whose column has the value."""
    return df.filter(F.col(column) == F.lit(value)).orderBy(position).limit(1)


def impute_normal(df: DataFrame, column: str, seed: int = 22) -> DataFrame:
    """Missing values replaced by draws from a normal distribution with the column's mean and deviation; a column without values stays as it is."""
    mean, std = df.agg(F.avg(column), F.stddev_samp(column)).first()
    if mean is None:
        return df
    return df.withColumn(column, F.coalesce(F.col(column), F.randn(seed) * F.lit(std or 0.0) + F.lit(mean)))
