"""Tables written once, bucketed by row key, so that each later join on the key reads them in place."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.operators.keyed import key_of
from rowdelta.options import DiffOptions
from rowdelta.plans.scratch import settled
from rowdelta.sources.dataset import KEY_COLUMN, Dataset

#: Batches whose keys are gathered before their files are merged.
MERGE_EVERY = 64


def _folder(spark: SparkSession, path: str):
    """A folder, wherever it lies, and the file system that has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place)


def make_folder(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.mkdirs(place)


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def _name(kind: str, path: str) -> str:
    """A table's name in the session's catalog; the table itself is the folder."""
    return f"rowdelta_{kind}_{hashlib.sha256(path.encode()).hexdigest()[:20]}"


def _register(spark: SparkSession, name: str, columns: str, buckets: int, path: str, partition: str = "") -> None:
    place = path.replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # only forgets it: the folder is the user's
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {partition} CLUSTERED BY ({KEY_COLUMN}) INTO {buckets} BUCKETS LOCATION '{place}'")


def _remembered(spark: SparkSession, path: str) -> int | None:
    """The number of buckets that an earlier run has chosen."""
    return spark.read.parquet(f"{path}/buckets").first()["n"] if exists(spark, f"{path}/buckets/_SUCCESS") else None


def _buckets(spark: SparkSession, path: str) -> int:
    n = _remembered(spark, path)
    if n is None:
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.range(1).select(F.lit(n).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets")
    return n


def prepare(data: Dataset, options: DiffOptions, path: str) -> Dataset:
    """``data`` as a table below ``path`` with its row key as a column, bucketed by it: written now, or found where an earlier run has finished writing it.

    The number of buckets is that of the session's shuffle partitions when it is first written. What is finished is told by the ``_SUCCESS`` files that Spark writes by default.
    """
    spark = data.df.sparkSession
    done = _remembered(spark, f"{path}/done") is not None
    n, name = _buckets(spark, path), _name("side", path)
    kept = data.df.drop(KEY_COLUMN).withColumn(KEY_COLUMN, key_of(data, options))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    if not done:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        kept.repartition(n, KEY_COLUMN).write.bucketBy(n, KEY_COLUMN).option("path", f"{path}/rows").mode("overwrite").format("parquet").saveAsTable(name)
        _buckets(spark, f"{path}/done")
    _register(spark, name, columns, n, f"{path}/rows")
    return Dataset(spark.table(name), data.headers, data.warnings, KEY_COLUMN)


class SeenKeys:
    """The keys of a stream's batches, bucketed, a partition for each batch; it outlives the session.

    A batch that runs again overwrites its own keys. Every ``MERGE_EVERY`` batches the keys of finished ones are rewritten as one partition, so that their files
    don't become many.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.buckets, self.name = _buckets(spark, path), _name("seen", path)
        make_folder(spark, f"{path}/rows")
        _register(spark, self.name, f"{KEY_COLUMN} string, epoch bigint", self.buckets, f"{path}/rows", "PARTITIONED BY (epoch)")
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def before(self, epoch: int | None = None) -> DataFrame:
        """Keys of the batches before ``epoch``; merged ones count as earlier than any."""
        rows = self.spark.table(self.name)
        return (rows if epoch is None else rows.where(F.col("epoch") < epoch)).select(KEY_COLUMN)

    def repeated(self, keys: DataFrame, epoch: int) -> str | None:
        """The least of the batch's keys that an earlier batch had."""
        return keys.join(self.before(epoch), KEY_COLUMN, "left_semi").agg(F.min(KEY_COLUMN)).first()[0]

    def add(self, keys: DataFrame, epoch: int) -> None:
        self._write(keys, epoch)

    def _write(self, keys: DataFrame, epoch: int) -> None:
        spark = keys.sparkSession
        view = f"{self.name}_new"
        keys.repartition(self.buckets, KEY_COLUMN).createOrReplaceTempView(view)
        spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (epoch = {epoch}) SELECT {KEY_COLUMN} FROM {view}")
        spark.catalog.dropTempView(view)

    def merge(self, epoch: int) -> None:
        """Before batch ``epoch`` begins all earlier ones are final: gather them, if they are many. A merge that breaks off leaves keys twice, which does no harm."""
        parts = [int(r[0].partition("=")[2]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]
        old = [p for p in parts if p < epoch]
        if len(old) < MERGE_EVERY:
            return
        self._write(settled(self.before(epoch).distinct()), min(-1, min(old) - 1))
        for p in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (epoch = {p})")
            remove_folder(self.spark, f"{self.path}/rows/epoch={p}")


def discard(data: Dataset, path: str) -> None:
    """Forget a prepared table and delete its folder."""
    spark = data.df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name('side', path)}")
    remove_folder(spark, path)
