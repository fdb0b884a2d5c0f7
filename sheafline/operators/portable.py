"""Values that can be stored anywhere: JSON as VARIANT, measured level by level under budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.markup import canonical_base64
from sheafline.operators.rounds import stages

# What stands for binary data in an object, and the codes of values that are refused.
BINARY_TAG = "binary/base64"
INVALID, TOO_LARGE = "invalid-persistence", "output-too-large"
FOREVER = (1 << 53) - 1


@dataclass(frozen=True)
class Limits:
    max_bytes: int = FOREVER
    max_text_bytes: int = FOREVER
    max_binary_bytes: int = FOREVER
    max_entries: int = 500_000
    max_depth: int = 128


def kind(v: Column) -> Column:
    """VOID, BOOLEAN, STRING, ARRAY, OBJECT or a number's type."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def measured_values(values: DataFrame, limits: Limits = Limits(), marker: str = "$binary") -> DataFrame:
    """``id, entries, depth, total_bytes, text_bytes, binary_bytes, canonical, error_code`` of ``id, json``.

    Every null, number, truth value, text, list and object is an entry; texts and
    names count their UTF-8 bytes, numbers 8, null and true 4, false 5, a list two
    bytes an element and two, an object two.  An object of ``marker`` with the
    binary tag and ``data``, canonical base64, is one entry and counts its text and
    32 bytes.  Values that are no JSON, null ones, and other objects with that
    marker have ``invalid-persistence``; those beyond a limit ``output-too-large``; the
    measures of both are null.  The canonical form has names in order and no space.

    A round looks at one level of all values and opens its lists and objects, so
    the rounds are the greatest depth, which the limits bound; what is beyond a
    limit is not opened further.
    """
    spark = values.sparkSession
    v = F.col("v")
    with stages(spark) as stage:
        roots = stage(values.select("id", F.try_parse_json("json").alias("v")))
        level = roots.where("v is not null").select("id", "v")
        found, depth = None, 0
        while True:
            of = kind(v)
            tagged = (of == "OBJECT") & F.try_variant_get(v, f"$['{marker}']", "string").isNotNull()
            data = F.try_variant_get(v, "$.data", "string")
            names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
            whole = tagged & (F.try_variant_get(v, f"$['{marker}']", "string") == BINARY_TAG) & (F.size(names) == 2) & canonical_base64(data).isNotNull()
            marked = F.coalesce((of == "OBJECT") & F.array_contains(names, marker), F.lit(False))
            text = F.when(of == "STRING", F.octet_length(F.try_variant_get(v, "$", "string"))).when((of == "OBJECT") & ~marked, F.aggregate(names, F.lit(0), lambda n, k: n + F.octet_length(k))).otherwise(0).cast("long")
            items = F.size(F.try_variant_get(v, "$", "array<variant>"))
            yes = F.try_variant_get(v, "$", "boolean")
            plain = F.when(of == "VOID", 4).when(of == "BOOLEAN", F.when(yes, 4).otherwise(5)).when(of == "STRING", 0).when(of == "ARRAY", items * 2 + 2).when(marked, F.octet_length(data) + 32).when(of == "OBJECT", 2).otherwise(8).cast("long")
            looked = stage(level.select("id", "v", of.alias("kind"), marked.alias("marked"), F.coalesce(marked & ~whole, F.lit(False)).alias("bad"), text.alias("text"), F.coalesce(plain, F.lit(0)).alias("plain"), F.when(whole, F.octet_length(canonical_base64(data))).otherwise(0).cast("long").alias("binary")))
            sums = looked.groupBy("id").agg(F.count("*").alias("entries"), F.sum("text").alias("text"), F.sum("plain").alias("plain"), F.sum("binary").alias("binary"), F.bool_or("bad").alias("bad"), F.lit(depth).alias("depth"))
            found = stage(sums if found is None else found.unionByName(sums).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("entries", "text", "plain", "binary")), F.bool_or("bad").alias("bad"), F.max("depth").alias("depth")))
            over = (F.col("entries") > limits.max_entries) | (F.col("text") > limits.max_text_bytes) | (F.col("binary") > limits.max_binary_bytes) | (F.col("text") + F.col("plain") > limits.max_bytes) | (F.col("depth") > limits.max_depth)
            open_ = looked.where("kind in ('ARRAY', 'OBJECT') and not marked").join(found.where(~over & ~F.col("bad")).select("id"), "id", "left_semi")
            inner = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("value").alias("inner"))).select("id", F.col("inner").alias("v"))
            level, depth = stage(inner), depth + 1
            if level.isEmpty():
                break
        facts = roots.join(found, "id", "left")
        error = F.when(F.col("v").isNull() | F.col("bad"), INVALID).when(over, TOO_LARGE)
        fine = lambda c: F.when(error.isNull(), c)
        return stage(
            facts.select(
                "id", fine(F.col("entries")).alias("entries"), fine(F.col("depth")).alias("depth"), fine(F.col("text") + F.col("plain")).alias("total_bytes"), fine(F.col("text")).alias("text_bytes"),
                fine(F.col("binary")).alias("binary_bytes"), fine(F.to_json("v")).alias("canonical"), error.alias("error_code"),
            ),
            keep=True,
        )
