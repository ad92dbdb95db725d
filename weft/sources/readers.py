"""Readers: explicit schemas, wide to long, composite keys, nested JSON, verified files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str, quote: str = '"', sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """Delimited text with a header. The schema is given, never inferred; column pruning reaches the reader."""
    df = spark.read.csv(path, schema=schema, header=True, quote=quote, sep=sep)
    return df.select(*columns) if columns else df


def with_suffix(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """The keys and the columns that end in ``suffix``, without it."""
    return df.select(*keys, *[F.col(c).alias(c.removesuffix(suffix)) for c in df.columns if c.endswith(suffix)])


def to_long(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """One row per key and column: never one column per entity further on."""
    return df.unpivot(keys, [c for c in df.columns if c not in keys], name, value)


def sdmx(df: DataFrame, composite: str, dimensions: list[str]) -> DataFrame:
    """Composite first column split, periods melted, ``:`` null, flags after the number dropped."""
    parts = F.split(composite, ",")
    rows = df.select(*[F.trim(parts[i]).alias(d) for i, d in enumerate(dimensions)], *[c for c in df.columns if c != composite])
    long = to_long(rows, dimensions, "period", "raw")
    number = F.trim(F.split(F.trim("raw"), " ")[0])
    return long.select(*dimensions, F.trim("period").alias("period"), F.when(number != ":", number).try_cast("double").alias("value"))


def point_series(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Per-point JSON with parallel arrays: (point, time, each variable)."""
    inner = "time: array<string>, " + ", ".join(f"{v}: array<double>" for v in variables)
    df = spark.read.json(path, schema=f"point bigint, hourly struct<{inner}>")
    zipped = F.arrays_zip("hourly.time", *[f"hourly.{v}" for v in variables])
    return df.select("point", F.explode(zipped).alias("x")).select("point", F.col("x.time").alias("time"), *[F.col(f"x.{v}").alias(v) for v in variables])


def polygons(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Features of GeoJSON documents: (id, parts, name), kept and renamed by ``names``. A Polygon is one part, a MultiPolygon several; a part is its outer
    ring, then its holes, as operators.polygons takes them. Other geometries have no parts."""
    schema = "features array<struct<properties: struct<id: string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = "array<array<array<double>>>"
    parts = F.when(kind == "Polygon", F.array(F.from_json(raw, rings))).when(kind == "MultiPolygon", F.from_json(raw, f"array<{rings}>")).otherwise(F.array().cast(f"array<{rings}>"))
    points = F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return features.select(F.col("f.properties.id").alias("id"), points.alias("parts")).where(F.col("id").isin(*names)).withColumn("name", F.try_element_at(table, F.col("id")))


def verified_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, bytes, sha256, md5) of binary files: provenance rows, to be joined with a manifest."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def freeze(df: DataFrame, path: str) -> None:
    """df as CSV under ``path``/data, and a manifest of its files' hashes beside it."""
    df.write.csv(f"{path}/data", header=True)
    verified_files(df.sparkSession, f"{path}/data/part-*").select("name", "sha256").write.json(f"{path}/manifest")


def frozen(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that ``freeze`` wrote. Raises ValueError if a file was edited, is missing or has been added since."""
    want = spark.read.json(f"{path}/manifest", schema="name string, sha256 string").withColumnRenamed("sha256", "want")
    both = verified_files(spark, f"{path}/data/part-*").select("name", "sha256").join(want, "name", "full_outer")
    wrong = both.where(~F.col("sha256").eqNullSafe(F.col("want"))).orderBy("name").limit(10).collect()
    if wrong:
        raise ValueError(f"files do not match the manifest: {', '.join(r['name'] for r in wrong)}")
    return csv(spark, f"{path}/data", schema)


def hourly_spine(bounds: DataFrame, start: str, end: str, at: str) -> DataFrame:
    return bounds.withColumn(at, F.explode(F.sequence(start, end, F.expr("interval 1 hour"))))


def merge_parameters(base: dict, overlay: dict) -> dict:
    """Recursive overlay; a value may not change its type (int to float may)."""
    out = dict(base)
    for key, value in overlay.items():
        old = base.get(key)
        if isinstance(old, dict) and isinstance(value, dict):
            out[key] = merge_parameters(old, value)
        elif old is not None and type(old) is not type(value) and not (isinstance(old, float) and isinstance(value, int)):
            raise TypeError(f"{key}: {type(old).__name__} expected, {type(value).__name__} given")
        else:
            out[key] = value
    return out
