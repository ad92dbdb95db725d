"""Helpers shared by the operators: shared-folder tables, checked broadcasts, ASCII-only word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.shared import fresh_path
from weft.operators.stats import numbered  # noqa: F401

#: Java regexes of the two word rules; both leave every non-ASCII character inside words.
SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]+"
#: The word rule of decontamination: digits, letters and every non-ASCII byte.
WORD_BYTES = bytes(b for b in range(256) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: For bytes.translate: A-Z lowered, every other delimiter a blank.
WORD_TABLE = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in WORD_BYTES else 0x20 for b in range(256))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that materialize wrote and nothing reads any more (an earlier round's)."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (counted with an early stop), else unchanged: the join then shuffles."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def before(df: DataFrame, keys: list[str], at: str, value: str, into: str, width: int = 4096) -> DataFrame:
    """df(keys, at, value) with ``into``: the sum of value over smaller ``at`` of the same keys. ``at`` holds whole numbers from 0;
    sums of ``width`` of them go first, so that a key of very many is no one task."""
    rows = df.withColumn("_part", F.expr(f"`{at}` div {width}"))
    sums = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_sum")).drop("_sum")
    own = F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(at)) - F.col(value)
    return rows.withColumn(into, own).join(sums, [*keys, "_part"]).withColumn(into, F.col(into) + F.col("_before")).drop("_part", "_before")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
