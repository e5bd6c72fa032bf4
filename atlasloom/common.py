"""Reading tables, picking current rows and cutting lineage; used by every operator."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def strip(col: Column) -> Column:
    """Without surrounding Unicode white space."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def newest(df: DataFrame, keys: Iterable[str], order: Iterable[Column]) -> DataFrame:
    """One row per key: the first by ``order``; ties fall to the least content hash, so the choice is repeatable.

    Spark turns this window into a group limit before the shuffle, so a key that holds a third of
    all rows leaves each map task as one row. Rows whose key is null are dropped.
    """
    keys, names = list(keys), list(df.columns)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    by = Window.partitionBy(*keys).orderBy(*order, F.xxhash64(*[df[c] for c in names]))
    rank = "__rank"
    while rank in names:
        rank += "_"
    return df.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) == 1).drop(rank)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


_made: list[str] | None = None


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside the block are deleted at its end; results must have been stored by then."""
    global _made
    outer, _made = _made, []
    try:
        yield
    finally:
        paths, _made = _made, outer
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> str:
    """The path of a table of ``df``, new in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if _made is not None:
        _made.append(path)
    df.write.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and go on from there.

    Lineage ends, a lost executor costs nothing, and unlike checkpoint() the reader prunes columns,
    knows the size and carries no constraints along, which double with every round of a loop.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``__no``, which grows in the order of ``keys`` and ``order``, and ``__range``, the task that holds the row.

    Rows are dealt by ranges, so a key that holds a third of all rows lies in many tasks.
    """
    by = [*map(F.col, keys), *order]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__no", F.monotonically_increasing_id())
    return cut(ranged).withColumn("__range", F.shiftright("__no", 33))


def _with_ranges(inside: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what the ranges of their key carry on: small rows, one for each range of a key."""
    to = ranges.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), *[c for c in ranges.columns if c not in (*keys, "__range")])
    on = F.col("__range") == F.col("__r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return inside.join(to, on, "left").drop("__r", *[f"__{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the running sums of ``sums`` along ``order`` for each key, the row included; null counts as 0.

    Sums run inside ranges, and the few totals of a key's ranges are carried on, so no key is ever one
    task's alone. Rows that are equal in ``order`` come in any order, but each counts once.
    """
    d = dealt(df.withColumns({f"__{c}": F.coalesce(v, F.lit(0)) for c, v in sums.items()}), keys, order)
    here = Window.partitionBy(*keys, "__range").orderBy("__no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "__range").agg(*[F.sum(f"__{c}").alias(f"__{c}") for c in sums])
    carried = totals.select(*keys, "__range", *[F.sum(f"__{c}").over(before).alias(f"__c_{c}") for c in sums])
    inside = d.withColumns({c: F.sum(f"__{c}").over(here) for c in sums})
    out = _with_ranges(inside, carried, keys)
    return out.select(*df.columns, *[(F.col(c) + F.coalesce(f"__c_{c}", F.lit(0))).alias(c) for c in sums])


def previous(df: DataFrame, keys: list[str], order: list[Column], column: str, name: str) -> DataFrame:
    """``df`` with ``column`` of the row before along ``order`` for each key as ``name``, null for the first; by ranges as in ``running``."""
    d = dealt(df, keys, order)
    here = Window.partitionBy(*keys, "__range").orderBy("__no")
    last = d.groupBy(*keys, "__range").agg(F.max_by(column, "__no").alias("__last"))
    carried = last.select(*keys, "__range", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__range")).alias("__carried"))
    inside = d.withColumns({"__lag": F.lag(column).over(here), "__first": F.row_number().over(here) == 1})
    return _with_ranges(inside, carried, keys).select(*df.columns, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__lag")).alias(name))
