"""A store that takes each key once, whichever batch brings it first.

Rows lie in folders by the hash of their key, so a batch meets only the folders
of its own keys.  A batch writes its rows as an attempt that nobody reads yet and
then claims the next number of the store's log by creating a file that must not
exist.  Who loses the race looks at what the winner has stored, takes those keys
out and tries the number after it.  So two batches never both store a key, what
is stored never changes, and a batch that runs again after its claim adds nothing.

The file system must create a file only once, as HDFS, local disks and the
hierarchical cloud stores do.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.operators.rounds import stages

BUCKETS = 64
#: Seconds after which a claim without content counts as lost.
LOST_S = 600


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "sha256", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._fs = None

    # the log ---------------------------------------------------------------------

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._fs or path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self._fs, path

    def _claim(self, number: int, attempt: str) -> bool:
        """Takes a number of the log for an attempt; false if another one has it."""
        fs, path = self._file(f"log/{number:012d}")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName() and not fs.exists(path):
                raise
            return False
        out.write(bytearray(attempt.encode()))
        out.close()
        return True

    def last(self) -> int:
        """The last number of the log that is taken; waits until its writer has said what for.

        A writer that was lost in between leaves an empty file, which counts as no
        claim after ``LOST_S`` seconds.
        """
        fs, path = self._file("log")
        while True:
            found = fs.listStatus(path) if fs.exists(path) else []
            files = {f.getPath().getName(): f for f in found if f.getPath().getName().isdigit()}
            now = time.time()
            if all(f.getLen() > 0 or now - f.getModificationTime() / 1000 > LOST_S for f in files.values()):
                return max(map(int, files), default=0)
            time.sleep(0.05)

    def log(self) -> DataFrame:
        """``attempt`` of every claim."""
        return self.spark.read.text(f"{self.path}/log").select(F.col("value").alias("attempt"))

    # rows ------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: list[int] | None = None) -> DataFrame | None:
        """What is stored, in the given folders; None if nothing ever was."""
        try:
            data = self.spark.read.parquet(f"{self.path}/data")
            log = self.log()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        data = data if buckets is None else data.where(F.col("bucket").isin(buckets))
        return data.join(log, "attempt", "left_semi").drop("bucket", "attempt")

    def write(self, batch: DataFrame, number: int, order: str | None = None) -> int:
        """Stores the batch's keys that are not stored yet, the first row of each by ``order``; the number of rows."""
        with stages(self.spark) as stage:
            one = batch.dropDuplicates([self.key]) if order is None else first_row(batch, self.key, order)
            own = stage(one.withColumn("bucket", self.bucket()))
            touched = sorted(r[0] for r in own.select("bucket").distinct().collect())  # one number a folder at most
            while True:
                seen = self.last()
                if seen and not self.log().where(F.startswith("attempt", F.lit(f"{number}-"))).isEmpty():
                    return 0  # this batch has its claim
                stored = self.rows(touched)
                new = own if stored is None else own.join(stored.select(self.key), self.key, "left_anti")
                attempt = f"{number}-{uuid.uuid4().hex}"
                new.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("bucket", "attempt").parquet(f"{self.path}/data")
                if self._claim(seen + 1, attempt):
                    return new_rows(self.spark, self.path, attempt)


def new_rows(spark: SparkSession, path: str, attempt: str) -> int:
    """How many rows an attempt has written: its folders alone are read."""
    try:
        return spark.read.parquet(f"{path}/data/bucket=*/attempt={attempt}").count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0  # all of its keys were stored before


def first_row(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by one aggregation with map-side combining."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def sink(path: str, key: str = "sha256", order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer for ``foreachBatch`` over a store at ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        KeyedStore(batch.sparkSession, path, key).write(batch, number, order)

    return write
