"""Files as rows: bounded, checksummed reads, format detection, delimited text."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions.text import format_of

#: Delimiters to tell apart, the earlier winning ties.
DELIMITERS = (",", ";", "\t", "|")
SNIFF_LINES = 20
MAX_BYTES = 100 << 20


def detected(content: Column, path: Column) -> Column:
    """Format by leading bytes, else by extension; null when neither tells."""
    head = F.substring(content, 1, 1024)
    return (
        F.when(F.startswith(head, F.lit(b"{\\rtf")), "rtf")
        .when(F.contains(head, F.lit(b"%PDF-")), "pdf")
        .when(F.startswith(head, F.lit(bytes.fromhex("d0cf11e0a1b11ae1"))), F.coalesce(format_of(path), F.lit("ole")))
        .when(F.startswith(head, F.lit(b"PK\x03\x04")), F.coalesce(format_of(path), F.lit("zip")))
        .otherwise(format_of(path))
    )


def resolved_format(explicit: Column | None, content: Column, path: Column) -> Column:
    """The format asked for, else the one detected; null where there is none."""
    found = detected(content, path)
    return found if explicit is None else F.coalesce(explicit, found)


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, explicit: str | None = None) -> DataFrame:
    """One row per file: digest, size, format, and an error code instead of a failed job.

    Files over ``max_bytes`` (``resourceLimit``) are told by their size and never
    read; the format of others may be unknown (``unsupported``).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = None if explicit is None else F.lit(explicit)
    small = files.where(F.col("length") <= max_bytes).select(
        "path", F.col("length").alias("n_bytes"), "modificationTime", F.sha2("content", 256).alias("sha256"), resolved_format(named, F.col("content"), F.col("path")).alias("format"), "content"
    )
    large = files.where(F.col("length") > max_bytes).select(
        "path", F.col("length").alias("n_bytes"), "modificationTime", *(F.lit(None).cast(t).alias(c) for c, t in (("sha256", "string"), ("format", "string"), ("content", "binary")))
    )
    code = F.when(F.col("n_bytes") > max_bytes, "resourceLimit").when(F.col("format").isNull(), "unsupported")
    return small.unionByName(large).select("path", "n_bytes", "modificationTime", "sha256", "format", code.alias("error_code"), "content")


#: Windows-1252 has characters where Latin-1 has the upper control codes (five of which stay).
UPPER = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-16 by its mark, UTF-8 (mark dropped), else Windows-1252."""
    after = lambda n: F.substring(content, n + 1, 1 << 30)
    mark = F.hex(F.substring(content, 1, 3))
    utf8 = F.try_validate_utf8(F.when(mark == "EFBBBF", after(3)).otherwise(content).cast("string"))
    return (
        F.when(F.startswith(mark, F.lit("FFFE")), F.decode(after(2), "UTF-16LE"))
        .when(F.startswith(mark, F.lit("FEFF")), F.decode(after(2), "UTF-16BE"))
        .otherwise(F.coalesce(utf8, F.translate(F.decode(content, "ISO-8859-1"), UPPER, WINDOWS)))
    )


def sniffed_delimiter(text: Column) -> Column:
    """The delimiter whose count per line agrees most often over the first lines."""
    lines = F.filter(F.slice(F.split(text, "\r\n|\n|\r"), 1, SNIFF_LINES), lambda x: F.length(x) > 0)

    # fixed values: a line weighs 1000, a delimiter 1, up to 500
    def score(delimiter: str) -> Column:
        counts = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))))
        widths = F.filter(F.array_distinct(counts), lambda k: k > 0)
        return F.array_max(F.transform(widths, lambda k: F.size(F.filter(counts, lambda c: c == k)) * 1000 + F.least(k + 1, F.lit(500))))

    entries = [F.struct(F.coalesce(score(d), F.lit(0)).alias("score"), F.lit(-i).alias("rank"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    return F.when(F.size(lines) == 0, ",").otherwise(F.array_max(F.array(*entries))["d"])


#: Fixed value: lines that tell how well a delimiter parts a text.
SCORED_LINES = 20


def delimiter_score(text: Column, delimiter: str) -> Column:
    """The most frequent number of delimiters a line, the greater of equals, times its lines, over the first lines that have any.

    Quoted text, line ends included, is passed over; a quote without an end hides
    the rest.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r'"(?:""|[^"])*+(?:"|\z)', "")
    counts = F.transform(F.split(bare, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))))
    first = F.slice(F.filter(counts, lambda n: n > 0), 1, SCORED_LINES)
    ranked = F.transform(F.array_distinct(first), lambda n: F.struct(F.size(F.filter(first, lambda k: k == n)).alias("lines"), n.alias("n")))
    best = F.array_max(ranked)
    return F.coalesce(best["lines"] * best["n"], F.lit(0))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All values as text, first line as header; the delimiter is told from the first lines."""
    if delimiter is None:
        head = "\n".join(r["value"] for r in spark.read.text(path).limit(SNIFF_LINES).collect())  # a few lines
        delimiter = spark.range(1).select(sniffed_delimiter(F.lit(head)).alias("d")).first()["d"]
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path, sep=delimiter)


ROWS = "{key}, row_no long, cells array<string>, error_code string"


def delimited_rows(texts: DataFrame, key: str, max_rows: int | None = None, max_cells: int | None = None) -> DataFrame:
    """Records of delimited texts (``key, text, delimiter``) as rows of cells, all of them text.

    A text with a quote that never closes, or over a cap on rows or cells, gives
    one row with an error code and no cells; other texts are not affected.
    """

    def records(text: str, delimiter: str) -> list[list[str]]:
        return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True) if r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        for part in batches:
            keys, places, cells, errors = [], [], [], []
            for k, text, delimiter in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows, error = records(text or "", delimiter or ","), None
                except csv.Error:
                    rows, error = [], "malformed"
                if (max_rows is not None and len(rows) > max_rows) or (max_cells is not None and sum(map(len, rows)) > max_cells):
                    rows, error = [], "resourceLimit"
                keys += [k] * (len(rows) or error is not None)
                places += range(len(rows)) if error is None else [None]
                cells += rows if error is None else [None]
                errors += [error] * (len(rows) or error is not None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, part.column(0).type), pa.array(places, pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array(errors, pa.string())], names=[part.schema.names[0], "row_no", "cells", "error_code"])

    return texts.select(key, "text", "delimiter").mapInArrow(run, ROWS.format(key=f"{key} {dict(texts.dtypes)[key]}"))
