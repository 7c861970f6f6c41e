"""Descriptive statistics and the data behind figures, as tidy frames.

Odd input: missing values are left out of every statistic; a column without values
has n = 0 and null statistics; an empty table gives the rows that its columns give;
ties have no order where none is stated; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import work_path


def unpivot(row: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """One wide row `<column>__<part>` into a row for each column."""
    pairs = ", ".join("'{}', {}".format(c, ", ".join(f"`{c}__{p}`" for p in parts)) for c in columns)
    return row.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, {', '.join(parts)})")


def mean_std(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))


def null_fraction(df: DataFrame) -> DataFrame:
    """column_name, fraction, ascending; one pass."""
    row = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"{c}__fraction") for c in df.columns))
    return unpivot(row, df.columns, ["fraction"]).orderBy("fraction", "column_name")


QUARTILES = (0.25, 0.5, 0.75)


def quartiles(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """column_name, q: the three quartiles of each column as an array, between neighbours in proportion.

    Exact ones are found by rank. Values are counted, the counts sorted into ranges of
    the values and written, and only the ranges that hold a wanted rank are numbered;
    so no task holds more than one range of a column's distinct values. exact=False
    takes one pass and a buffer of bounded size for each column.

    Nulls are left out and NaN is the largest value; a column without values has no row.
    """
    if not exact:
        q = F.array(*map(F.lit, QUARTILES))
        row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), q, F.lit(10000)).alias(f"{c}__q") for c in columns))
        return unpivot(row, columns, ["q"]).filter("q is not null")
    spark, path = df.sparkSession, work_path(df.sparkSession, "counts")
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("cell"))
    counts = cells.select("cell.*").filter("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("column_name", "value").withColumn("range_", F.spark_partition_id()).write.parquet(path)
    counts = spark.read.parquet(path)
    column = Window.partitionBy("column_name")
    sizes = counts.groupBy("column_name", "range_").agg(F.sum("n").alias("size"))
    sizes = sizes.select("column_name", "range_", F.sum("size").over(column.orderBy("range_")).alias("end"), "size", F.sum("size").over(column).alias("total"))
    places = F.array(*(F.lit(p) * (F.col("total") - 1) for p in QUARTILES))
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(F.floor(x), F.ceil(x)))))
    begin = F.col("end") - F.col("size")
    sizes = sizes.select("column_name", "range_", "total", begin.alias("begin"), F.filter(ranks, lambda r: (r >= begin) & (r < F.col("end"))).alias("ranks")).filter(F.size("ranks") > 0)
    upto = F.col("begin") + F.sum("n").over(Window.partitionBy("column_name", "range_").orderBy("value"))
    held = counts.join(F.broadcast(sizes), ["column_name", "range_"]).withColumn("upto", upto)  # six ranges of a column at most
    held = held.select("column_name", "total", "value", F.explode(F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))).alias("rank"))
    at = held.groupBy("column_name", "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    low, high = lambda x: F.try_element_at("at", F.floor(x)), lambda x: F.try_element_at("at", F.ceil(x))
    between = lambda x: F.when(F.ceil(x) > F.floor(x), (F.ceil(x) - x) * low(x) + (x - F.floor(x)) * high(x)).otherwise(low(x))
    return at.select("column_name", F.transform(places, between).alias("q"))


def describe(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """count, mean, std, least, quartiles, largest of each column; nulls where a column has no values."""
    parts = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "low": F.min, "high": F.max}
    aggs = [f(F.col(c).cast("double")).alias(f"{c}__{p}") for c in columns for p, f in parts.items()]
    rows = unpivot(df.agg(*aggs), columns, list(parts)).join(quartiles(df, columns, exact), "column_name", "left")
    return rows.select("column_name", "n", "mean", "std", "low", *(F.get("q", F.lit(i)).alias(f"q{25 * i + 25}") for i in range(3)), "high")


def info(df: DataFrame) -> DataFrame:
    """column_name, n: values that are not missing."""
    return unpivot(df.agg(*(F.count(F.col(f"`{c}`")).alias(f"{c}__n") for c in df.columns)), df.columns, ["n"])


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def head_tail(df: DataFrame, position: str, n: int = 5) -> DataFrame:
    """The first and last n rows by a position, marked `part`."""
    head = df.orderBy(F.asc(position)).limit(n).withColumn("part", F.lit("head"))
    return head.unionByName(df.orderBy(F.desc(position)).limit(n).withColumn("part", F.lit("tail")))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


def mean_by(df: DataFrame, by: str, column: str) -> DataFrame:
    """Mean with a 95 % normal interval for each category."""
    rows = df.groupBy(by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    half = F.lit(1.96) * F.col("std") / F.sqrt("n")
    return rows.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def boxplot(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, outliers."""
    c = F.col(column).cast("double")
    q = quartiles(df, [column], exact).agg(F.first("q").alias("q")).select(*(F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = c.between(low, high)
    both = df.select(column).join(F.broadcast(q))  # a single row
    return both.groupBy("q1", "q2", "q3").agg(F.min(F.when(inside, c)).alias("whisker_low"), F.max(F.when(inside, c)).alias("whisker_high"), F.count_if(~inside).alias("outliers"))


def bin_of(c: Column, low: Column, high: Column, bins: int) -> Column:
    width = F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(0.0))
    return F.least(F.floor(width * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Counts by bins of equal width in every column: b_<column>..., cnt. Two columns give the data of a pair plot."""
    ends = df.agg(*(f(F.col(c).cast("double")).alias(f"__{e}_{c}") for c in columns for e, f in (("low", F.min), ("high", F.max))))
    placed = df.select(*columns).dropna().join(F.broadcast(ends))  # a single row
    placed = placed.select(*(bin_of(F.col(c).cast("double"), F.col(f"__low_{c}"), F.col(f"__high_{c}"), bins).alias(f"b_{c}") for c in columns))
    return placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("cnt"))


def density(df: DataFrame, column: str, by: str | None = None, points: int = 200) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on a common grid: [by,] x, y. Of groups, jointly normalised.

    The grid reaches three bandwidths beyond the data. All grid points are
    aggregates of the same pass: a row is never multiplied by the grid.
    """
    c = F.col(column).cast("double")
    keys = [by] if by else []
    data = df.filter(c.isNotNull())
    overall = data.agg(F.count(c).alias("n"), F.stddev_samp(c).alias("s"), F.min(c).alias("low"), F.max(c).alias("high")).first()
    if not overall.n or not overall.s:
        return df.sparkSession.createDataFrame([], ", ".join([*(f"{k} string" for k in keys), "x double", "y double"]))
    h = overall.s * overall.n ** (-0.2)
    low, high = overall.low - 3 * h, overall.high + 3 * h
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]
    widths = data.groupBy(*keys).agg(F.count(c).alias("__n"), (F.stddev_samp(c) * F.pow(F.count(c), F.lit(-0.2))).alias("__h"))
    joined = data.select(c.alias("__x"), *keys).join(F.broadcast(widths) if not keys else widths, keys or None)
    kernel = lambda g: F.sum(F.exp(-0.5 * F.pow((F.lit(g) - F.col("__x")) / F.col("__h"), F.lit(2))))
    sums = joined.filter("__h > 0").groupBy(*keys, "__h").agg(F.array(*(kernel(g) for g in grid)).alias("__y"))
    y = F.col("__y1") / (F.col("__h") * (2 * 3.141592653589793) ** 0.5 * overall.n)
    return sums.select(*keys, "__h", F.posexplode("__y").alias("__i", "__y1")).select(*keys, F.get(F.array(*map(F.lit, grid)), F.col("__i")).alias("x"), y.alias("y"))
