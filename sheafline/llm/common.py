"""Small helpers shared by the training-data operators.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``.  ``bytes.split()``
splits on exactly that set, so words are always taken from the UTF-8 form.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about this many bytes inside a task.
SLICE_BYTES = 4 << 20
#: Slices for hashing, which holds several 8-byte numbers for each text byte.
HASH_SLICE_BYTES = 3 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``.

    Only a local master, which is one machine, may do without that setting; there
    a folder of its own is taken once for each application.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _local.get(app) or _local.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return path.rstrip("/")


_local: dict[str, str] = {}
_block: ContextVar[list[str] | None] = ContextVar("block", default=None)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    Unlike a cached frame the files outlive the executors that wrote them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheafline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (own := _block.get()) is not None:
        own.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` has made and nothing reads any more."""
    for table in tables:
        path = getattr(table, "written_path", None)
        if path is not None:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose written tables are deleted at its end, but those given to ``keep``.

    What the block returns must read kept tables only.
    """
    paths: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.written_path)
        return table

    before = _block.set(paths)
    try:
        yield keep
    finally:
        _block.reset(before)
        if (outer := _block.get()) is not None:
            outer.extend(kept)
        for path in paths:
            if path not in kept:
                _delete(spark, path)


def id_mod(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (native)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def py_id_mod(value: int, modulus: int) -> int:
    return zlib.crc32(str(value).encode()) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``limit`` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        # the offsets of a string array tell its bytes without a pass
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def one_row_per_doc(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators read; other columns may clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def kept_rows(docs: DataFrame, make_scorer: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose text passes, with all their columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make_scorer()
        for part in slices(batches):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            yield part.filter(pa.array([passes(t) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
