"""A catalogue as tables rebuilt from the facts, and its comparison with an older copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reconcile(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, kind, field, stored, fresh): keys on one side only and fields that differ; the fresh side is right."""
    a, b = (df.select(*keys, F.struct(*fields).alias(n)) for df, n in ((stored, "s"), (fresh, "f")))
    # Nulls equal each other, as in all checks: a null key is on both sides, not on each alone.
    sides = a.withColumn("f", F.lit(None).cast(b.schema["f"].dataType)).unionByName(b.withColumn("s", F.lit(None).cast(a.schema["s"].dataType)))
    both = sides.groupBy(*keys).agg(F.first("s", ignorenulls=True).alias("s"), F.first("f", ignorenulls=True).alias("f"))
    differing = F.array(*[F.when(~F.col(f"s.{f}").eqNullSafe(F.col(f"f.{f}")), F.struct(F.lit("field_differs").alias("kind"), F.lit(f).alias("field"), F.col(f"s.{f}").cast("string").alias("stored"), F.col(f"f.{f}").cast("string").alias("fresh"))) for f in fields])
    alone = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("stored"), F.lit(None).cast("string").alias("fresh")))
    found = F.when(F.col("s").isNull(), alone("not_in_stored")).when(F.col("f").isNull(), alone("not_in_fresh")).otherwise(F.array_compact(differing))
    return both.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")


def refresh(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> int:
    """Write all tables of the catalogue as one new version, and commit it with a marker last; gives its number.

    A version is a folder of its own that is never written again, so :func:`read` sees all tables of one version or all of
    the one before, and a refresh that stops half way changes nothing. Versions stay until :func:`forget`.
    """
    store = _Pointer(spark, path)
    last = store.current()
    number = 0 if last is None else last + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/version={number}/{name}")
    store.move(number)
    return number


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the catalogue's present version, or of the named one."""
    number = _Pointer(spark, path).current() if version is None else version
    if number is None:
        raise FileNotFoundError(f"no version of the catalogue under {path}")
    return spark.read.parquet(f"{path}/version={number}/{name}")


def forget(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove versions before the last ``keep``, which no reader should still be reading."""
    store = _Pointer(spark, path)
    for number in range(max((store.current() or 0) - keep + 1, 0)):
        store.remove(f"{path}/version={number}")


class _Pointer:
    """Markers of whole versions, in any file system that Spark can reach: the highest is the present one."""

    def __init__(self, spark: SparkSession, path: str):
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = self.at(f"{path}/committed")
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        if not self.files.exists(self.folder):
            return None
        return max((int(s.getPath().getName()) for s in self.files.listStatus(self.folder) if s.getPath().getName().isdigit()), default=None)

    def move(self, number: int) -> None:
        """Two refreshes cannot both make a version: the second finds its marker there."""
        if not self.files.createNewFile(self.at(self.folder, str(number))):
            raise FileExistsError(f"version {number} of the catalogue is committed already")

    def remove(self, path: str) -> None:
        self.files.delete(self.at(path), True)


def upsert(df: DataFrame, path: str, key: str) -> None:
    """Replace the rows of the keys in ``df``: only their partitions are written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
