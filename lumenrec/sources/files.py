"""Reading and writing: delimited files, word vectors, Parquet tables with declared schemas, JDBC."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import NA_VALUES, na_to_null

# Schemas of the log tables.
USERS = "tg_id BIGINT, language_code STRING, first_name STRING, last_name STRING, username STRING"
REQUESTS = f"{USERS}, date TIMESTAMP, request STRING"
FEEDBACKS = f"{USERS}, date TIMESTAMP, feedbacks STRING"
MESSAGES = "tg_id BIGINT, msg STRING"
TABLES = {"users": USERS, "users_requests": REQUESTS, "users_feedbacks": FEEDBACKS, "request": MESSAGES, "feedback": MESSAGES}


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; only a local session without it gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        master = conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.environ.get("LUMENREC_WORK") or os.environ.setdefault("LUMENREC_WORK", tempfile.mkdtemp(prefix="lumenrec-"))
    return f"{root.rstrip('/')}/work/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A headed CSV file; quotes, doubled quotes and line ends inside fields; missing-value spellings become NULL.

    With a schema, columns are read as text first and cast where they can be, so a
    bad cell is NULL, not an error; without one all columns stay text.
    """
    raw = spark.read.options(header=True, multiLine=True, escape='"', quote='"').csv(path)
    raw = raw.select(*(na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns))
    if schema is None:
        return raw
    fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
    return raw.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"', quote='"').csv(path)


def read_word_vectors(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """token, vec from `token number number ...` lines; of a repeated token the last line counts, missing-value tokens are left out."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = F.split("value", " ")
    vectors = lines.select(F.get(parts, F.lit(0)).alias("token"), F.slice(parts, 2, dimensions).cast("array<double>").alias("vec"), "line")
    return vectors.filter(~F.col("token").isin(NA_VALUES)).groupBy("token").agg(F.max_by("vec", "line").alias("vec"))


def with_row_id(df: DataFrame, key: str, name: str = "row_id") -> DataFrame:
    """Dense positions 0..n-1 in the order of a stable key, without one task for all rows; nulls come first.

    Rows are sorted into ranges of the key and numbered within each range as they are
    written; a row's position is its number after the sizes of the ranges before it,
    of which there is one for each task.
    """
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    spark, path = df.sparkSession, work_path(df.sparkSession, "rows")
    # the id's upper bits number the range, the lower ones count within it
    df.repartitionByRange(key).sortWithinPartitions(key).withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part, nth = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("range_")).agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("range_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_"))
    numbered = rows.join(F.broadcast(base), part == F.col("range_"))
    return numbered.withColumn(name, F.col("base_") + nth).select(*(F.col(f"`{c}`") for c in df.columns), name)


def write_jdbc(df: DataFrame, url: str, name: str, user: str, password: str, mode: str = "append") -> None:
    """Append to a database table, one connection for each task."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=name, user=user, password=password).save()


def read_jdbc(spark: SparkSession, url: str, name: str, user: str, password: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, user=user, password=password).load()


def create_table(spark: SparkSession, name: str, schema: str, replace: bool = False) -> None:
    """Create a Parquet table if it is absent, or anew."""
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def create_log_tables(spark: SparkSession, replace: bool = False) -> None:
    for name, schema in TABLES.items():
        create_table(spark, name, schema, replace)


def run_sql(spark: SparkSession, query: str, **args: object) -> DataFrame:
    """Any SQL, parameters by name; errors are raised."""
    return spark.sql(query, args=args or None)


def too_long(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Rows in which a text is longer than its declared width."""
    wide = F.lit(False)
    for c, n in widths.items():
        wide = wide | F.coalesce(F.length(c) > n, F.lit(False))
    return df.filter(wide)
