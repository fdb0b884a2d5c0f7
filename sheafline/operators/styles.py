"""Cascade of style rules: rules as rows, met by the tags and classes of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.operators.rounds import dealt

#: What an inline style counts for, and what important declarations count for above all others.
INLINE, IMPORTANT = 1000, 10_000
#: Elements of a task; each meets some ten declarations.
PER_TASK = 20_000
#: The properties that the cascade decides on.
PROPERTIES = ("bold", "italic", "strike", "hidden")


def declarations(body: Column) -> Column:
    """``property, value, important`` of a declaration block, in order; only those that make text bold, italic, struck or hidden."""

    def read(d: Column) -> Column:
        name, rest = F.lower(F.trim(F.substring_index(d, ":", 1))), F.trim(F.lower(F.substr(d, F.locate(":", d) + 1)))
        value = F.rtrim(F.substring_index(rest, "!", 1))
        important = F.contains(rest, F.lit("!")) & (F.trim(F.substr(rest, F.locate("!", rest) + 1)) == "important")
        heavy = value.isin("bold", "bolder") | (F.coalesce(value.try_cast("int"), F.lit(0)) >= 600)
        lined = F.when(F.contains(value, F.lit("line-through")), True).when(value == "none", False)
        said = (
            F.when(name == "font-weight", F.struct(F.lit("bold").alias("property"), heavy.alias("value"), important.alias("important")))
            .when(name == "font-style", F.struct(F.lit("italic").alias("property"), value.isin("italic", "oblique").alias("value"), important.alias("important")))
            .when(name.isin("text-decoration", "text-decoration-line") & lined.isNotNull(), F.struct(F.lit("strike").alias("property"), lined.alias("value"), important.alias("important")))
            .when(name == "display", F.struct(F.lit("hidden").alias("property"), (value == "none").alias("value"), important.alias("important")))
        )
        return F.when(F.contains(d, F.lit(":")), said)

    return F.filter(F.transform(F.split(body, ";"), read), lambda d: d.isNotNull())


def style_rules(sheets: DataFrame) -> DataFrame:
    """``page_id, tag, class, weight, rule_no, property, value`` of style sheets ``page_id, css``.

    Selectors are a tag, a class or both; all others are passed over.  A comment
    without an end hides the rest.  Later rules have greater numbers.
    """
    clean = F.regexp_replace(F.coalesce("css", F.lit("")), r"(?s)/\*.*?(\*/|\z)", "")
    chunks = sheets.select("page_id", F.posexplode(F.split(clean, r"\}")).alias("chunk_no", "chunk")).where(F.contains("chunk", F.lit("{")))
    parts = chunks.select("page_id", "chunk_no", F.substring_index("chunk", "{", 1).alias("selectors"), declarations(F.substr("chunk", F.locate("{", F.col("chunk")) + 1)).alias("said"))
    one = parts.where(F.size("said") > 0).select("page_id", "chunk_no", "said", F.posexplode(F.split("selectors", ",")).alias("selector_no", "selector"))
    one = one.withColumn("selector", F.regexp_replace("selector", r"^\s+|\s+$", "")).where("selector <> '' and not selector rlike '[ :\\\\[]'")
    tag = F.lower(F.substring_index("selector", ".", 1))
    named = F.contains("selector", F.lit("."))
    keyed = one.select(
        "page_id", F.nullif(tag, F.lit("")).alias("tag"), F.when(named, F.substr("selector", F.locate(".", F.col("selector")) + 1)).alias("class"),
        (F.col("chunk_no") * 100_000 + F.col("selector_no")).cast("long").alias("rule_no"), F.posexplode("said").alias("said_no", "d"),
    )
    weight = F.when(F.col("class").isNotNull(), 10).otherwise(0) + F.when(F.col("tag").isNotNull(), 1).otherwise(0) + F.when(F.col("d.important"), IMPORTANT).otherwise(0)
    return keyed.select("page_id", "tag", "class", weight.alias("weight"), "rule_no", "said_no", "d.property", "d.value")


def cascaded(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, element`` and a column for each property of the elements that some rule or inline style speaks of.

    ``elements`` has ``page_id, element, tag, classes, style`` (its inline style, or
    null).  Of what is said of a property the greatest weight wins, then the last:
    normal rules by specificity, the inline style, important rules, important inline
    style.  Each element meets rules by equal keys only: its tag, its classes, and
    both.
    """
    seen = F.array_distinct(F.coalesce("classes", F.array().cast("array<string>")))
    tag = F.lower("tag")
    keys = F.concat(
        F.array(F.struct(tag.alias("tag"), F.lit(None).cast("string").alias("class"))),
        F.transform(seen, lambda c: F.struct(F.lit(None).cast("string").alias("tag"), c.alias("class"))),
        F.transform(seen, lambda c: F.struct(tag.alias("tag"), c.alias("class"))),
    )
    n = elements.count()
    asked = elements.select("page_id", "element", F.explode(keys).alias("k")).select("page_id", "element", F.to_json("k").alias("k"))
    given = rules.select("page_id", F.to_json(F.struct("tag", "class")).alias("k"), "weight", "rule_no", "said_no", "property", "value")
    met = dealt(asked, n, PER_TASK, "page_id", "k").join(dealt(given, n, PER_TASK, "page_id", "k"), ["page_id", "k"]).drop("k")
    inline = elements.where("style is not null").select("page_id", "element", F.posexplode(declarations(F.col("style"))).alias("said_no", "d"))
    own = inline.select("page_id", "element", (INLINE + F.when(F.col("d.important"), IMPORTANT).otherwise(0)).alias("weight"), F.lit(0).cast("long").alias("rule_no"), "said_no", "d.property", "d.value")
    said = dealt(met.unionByName(own), n, PER_TASK, "page_id", "element")
    last = lambda p: F.max_by(F.when(F.col("property") == p, F.col("value")), F.when(F.col("property") == p, F.struct("weight", "rule_no", "said_no"))).alias(p)
    return said.groupBy("page_id", "element").agg(*map(last, PROPERTIES))
