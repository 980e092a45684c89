"""A table of last states: rows by key, each micro-batch a version of those it touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def committed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Kind and number of the folders ``kind=number`` in ``path`` whose write was committed, in order of number."""
    jvm = spark._jvm
    home = jvm.org.apache.hadoop.fs.Path(path)
    store = home.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in store.listStatus(home) if store.exists(home) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if number.isdigit() and store.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append((kind, int(number)))
    return sorted(found, key=lambda x: x[1])


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folder_rows(spark: SparkSession, path: str, before: int, schema: T.StructType) -> DataFrame:
    """Rows of the last ``batch=N`` in ``path`` with N below ``before``, each of which holds all rows; earlier ones go."""
    numbers = [n for _, n in committed(spark, path) if n < before]
    for n in numbers[:-1]:
        drop_folder(spark, f"{path}/batch={n}")
    return spark.read.schema(schema).parquet(f"{path}/batch={numbers[-1]}") if numbers else spark.createDataFrame([], schema)


class VersionedTable:
    """Rows by key in folders ``batch=N`` (rows changed in batch N) and ``base=N`` (all rows as of batch N).

    A batch written again replaces what its first attempt left, and readers take only folders whose write
    was committed, so a stream that repeats its last batch after a failure changes nothing.  Every
    ``every`` batches the changes are put together into a new base and older ones go, so a read opens
    a bounded number of folders.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, every: int = 20):
        self.spark, self.path, self.keys, self.schema, self.every = spark, path, keys, schema, every

    def latest(self, before: int | None = None) -> DataFrame:
        """The last state of every key, as of the batches below ``before``."""
        found = [(kind, n) for kind, n in committed(self.spark, self.path) if before is None or n < before]
        since = max((n for kind, n in found if kind == "base"), default=-1)
        paths = [f"{self.path}/{kind}={n}" for kind, n in found if n > since or (kind, n) == ("base", since)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("__version", T.LongType())])).parquet(*paths)
        values = [c for c in self.schema.names if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "__version").alias("__row"))
        return last.select(*[c if c in self.keys else F.col(f"__row.{c}").alias(c) for c in self.schema.names])

    def write(self, batch: int, rows: DataFrame) -> None:
        """Put the new states of the keys that ``batch`` touched."""
        stated = rows.select(*self.schema.names, F.lit(batch).cast("bigint").alias("__version"))
        stated.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if batch % self.every == self.every - 1:
            self.latest().withColumn("__version", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/base={batch}")
            for kind, number in committed(self.spark, self.path):  # the base before this one stays for a repeated batch
                if number < batch - self.every or (kind, number) == ("batch", batch - self.every):
                    drop_folder(self.spark, f"{self.path}/{kind}={number}")
