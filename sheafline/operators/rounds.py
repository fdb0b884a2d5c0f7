"""Help for operators that work in rounds or over whole keys: tables between rounds, running values of long keys, joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``; a local master may do without."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))
    return path.rstrip("/")


@contextmanager
def stages(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """``stage(df)`` writes a table to the shared folder and reads it back, which cuts lineage.

    The tables outlive the executors that wrote them and are deleted at the block's
    end, but for those written with ``keep=True``, which the block may return.
    """
    gone: list[str] = []

    def stage(df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{shared_dir(spark)}/sheafline/stage-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not keep:
            gone.append(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield stage
    finally:
        for path in gone:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tasks_for(spark: SparkSession, size: int, per_task: int) -> int:
    """Tasks for a size at ``per_task`` each, one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-size // per_task))


def dealt(rows: DataFrame, n_rows: int, per_task: int, *keys: str) -> DataFrame:
    """``rows`` dealt to as many tasks as ``n_rows`` of them need at ``per_task`` each, by ``keys`` or evenly.

    The number is given to Spark, which else puts well-compressed partitions together
    until a task's rows are many times their size on disk.
    """
    return rows.repartition(tasks_for(rows.sparkSession, n_rows, per_task), *keys)


def running(rows: DataFrame, keys: Sequence[str], order: str, block: int, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, last: int = 0, tasks: int | None = None) -> DataFrame:
    """Running sums and maxima of a key's rows in order, up to and including each row (``last=-1``: without it).

    ``order`` is a whole number and keys are not null.  A key's rows are dealt to blocks of ``block``
    consecutive numbers; what the blocks before have is composed from one row for
    each block, so that no task holds a key's rows.  Sparse numbers make small
    blocks: their number, not that of the rows, bounds the one window over a key.
    With ``tasks`` blocks are dealt to that many.
    """
    sums, maxima = sums or {}, maxima or {}
    placed = rows.withColumns({"run__block": F.floor(F.col(order) / block), **{f"run__{n}": c for n, c in (sums | maxima).items()}})
    places = [*keys, "run__block"]
    placed = placed if tasks is None else placed.repartition(tasks, *places)
    totals = placed.groupBy(*places).agg(*(F.sum(f"run__{n}").alias(f"all__{n}") for n in sums), *(F.max(f"run__{n}").alias(f"all__{n}") for n in maxima))
    before = Window.partitionBy(*keys).orderBy("run__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*places, *(F.sum(f"all__{n}").over(before).alias(f"was__{n}") for n in sums), *(F.max(f"all__{n}").over(before).alias(f"was__{n}") for n in maxima))
    within = Window.partitionBy(*places).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    none = lambda n: F.coalesce(F.col(f"was__{n}"), F.lit(0))
    out = {n: F.coalesce(F.sum(f"run__{n}").over(within), F.lit(0)) + none(n) for n in sums} | {n: F.greatest(F.max(f"run__{n}").over(within), f"was__{n}") for n in maxima}
    both = placed.join(carried, places, "left")
    return both.withColumns(out).drop("run__block", *(f"{p}__{n}" for p in ("run", "was") for n in (*sums, *maxima)))


#: A key with more than this share of the rows is dealt to ``SALTS`` tasks; there are fewer such keys than this number.
HOT_SHARE, SALTS = 200, 32


def looked_up(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "left") -> DataFrame:
    """``rows`` with the one row of ``facts`` that has their ``key``; rows of a hot key are dealt to several tasks by ``by``.

    Hot keys are fewer than ``HOT_SHARE``, so what says which they are is broadcast.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("hot__n"))
    hot = F.broadcast(counts.where(F.col("hot__n") * HOT_SHARE > rows.count()).select(key, F.lit(True).alias("hot__key")))
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    marked = rows.join(hot, key, "left").withColumn("hot__salt", F.when(F.col("hot__key"), salt).otherwise(0))
    salts = F.when(F.col("hot__key"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = facts.join(hot, key, "left").withColumn("hot__salt", F.explode(salts))
    return marked.drop("hot__key").join(spread.drop("hot__key"), [key, "hot__salt"], how).drop("hot__salt")
