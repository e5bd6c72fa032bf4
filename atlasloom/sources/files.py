"""Reading and writing: tables by format, registries, and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats that need no schema to read.
TYPED = ("parquet", "orc")


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table of ``path``; untyped formats need a schema, so no pass over the data guesses one."""
    if form not in TYPED and schema is None:
        raise ValueError(f"{form} needs a schema")
    r = spark.read.format(form).options(**options)
    return (r.schema(schema) if schema is not None else r).load(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(model, settings map<string,string>) of a JSON object of objects, one row per entry."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("model", "v")).select("model", F.from_json("v", "map<string,string>").alias("settings"))


def markdown_files(df: DataFrame, path: str, name: str, text: str) -> None:
    """One text file set per value of ``name``."""
    df.select(F.col(name).alias("document"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("document").text(path)


def snapshot(df: DataFrame, path: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a version of the table at ``path``; a version that exists is an error, so none is lost."""
    to = f"{path}/version={version:012d}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(to)
    return to


def versions(spark: SparkSession, path: str) -> list[int]:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    if not found.exists(fs):
        return []
    names = [s.getPath().getName() for s in found.listStatus(fs)]
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and found.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def at_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of ``version``, the newest complete one by default."""
    have = [v for v in versions(spark, path) if version is None or v <= version]
    if not have:
        raise FileNotFoundError(f"no version of {path}")
    return spark.read.parquet(f"{path}/version={have[-1]:012d}")
