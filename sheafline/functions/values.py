"""How cell values turn into text, and how they compare.

A blank is a null or an empty string.  Comparison is total: two numbers compare
as numbers, everything else as text, by natural order (digit runs as numbers)
without regard to case and accents.  A test may be null where a blank fails it,
so that scans can prune by it; ``table.condition`` takes null for false.
"""

from __future__ import annotations

import operator as op

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Ignores case and accents.
LOOSE = "UNICODE_CI_AI"


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, NUMBERS)


def blank(column: Column, kind: T.DataType) -> Column:
    return (column.isNull() | (column == F.lit(""))) if isinstance(kind, T.StringType) else column.isNull()


def number_text(column: Column) -> Column:
    """A double's shortest text: no ``.0``, plain digits from 1e-6 up to 1e21, else ``1e+21``."""
    c = column.cast("double")
    size = F.abs(c)
    plain = c.cast("string").cast("decimal(38,16)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    small = F.regexp_replace(F.regexp_replace(c.cast("string").cast("decimal(38,25)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0E", "E"), "E(-?)", "e$1")
    power = F.regexp_replace(power, r"e(\d)", "e+$1")
    return (
        F.when(F.isnan(c), "NaN")
        .when(size == float("inf"), F.when(c > 0, "Infinity").otherwise("-Infinity"))
        .when(c == 0, "0")
        .when((size >= 1e21) | (size < 1e-6), power)
        .when(size < 1e-3, small)
        .otherwise(plain)
    )


def text(column: Column, kind: T.DataType) -> Column:
    """A value as text; blanks are empty."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        out = number_text(column)
    else:
        out = column.cast("string")
    return F.coalesce(out, F.lit(""))


def natural_key(column: Column) -> Column:
    """Text whose collated order takes digit runs as numbers, however long.

    A run is led by its number of digits, and that by its own number of digits.
    """
    pieces = F.regexp_extract_all(F.lower(column), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def sortable(piece: Column) -> Column:
        digits = F.ltrim(piece, F.lit("0"))
        size = F.length(digits).cast("string")
        return F.when(piece.rlike("^[0-9]"), F.concat(F.length(size).cast("string"), size, digits)).otherwise(piece)

    return F.collate(F.array_join(F.transform(pieces, sortable), ""), LOOSE)


COMPARISONS = {
    "equals": op.eq, "not-equals": op.ne, "greater-than": op.gt, "greater-than-or-equal": op.ge, "less-than": op.lt, "less-than-or-equal": op.le,
}
#: Of the comparisons with a value that is not blank, those that a blank meets.
BLANK_PASSES = ("not-equals", "less-than", "less-than-or-equal")


def compare(column: Column, kind: T.DataType, operator: str, value: object) -> Column:
    """One of the eleven predicate operators against a literal."""
    if operator == "is-blank":
        return blank(column, kind)
    if operator == "is-not-blank":
        return ~blank(column, kind)
    if operator in ("contains", "starts-with", "ends-with"):
        want = F.lit(literal_text(value).lower())
        # no blank contains a text that is not empty
        have = F.lower(column if isinstance(kind, T.StringType) and literal_text(value) else text(column, kind))
        return {"contains": F.contains, "starts-with": F.startswith, "ends-with": F.endswith}[operator](have, want)
    if is_number(kind) and isinstance(value, (int, float)) and not isinstance(value, bool):
        # a blank is before every number's text
        test = COMPARISONS[operator](column, F.lit(value))
        return test | column.isNull() if operator in BLANK_PASSES else test
    wanted = literal_text(value)
    if isinstance(kind, T.StringType) and wanted and not any(c.isdigit() for c in wanted):
        # digit runs keep their place among other characters, so the text itself compares
        test = COMPARISONS[operator](F.collate(column, LOOSE), F.collate(F.lit(wanted), LOOSE))
        return test | column.isNull() if operator in BLANK_PASSES else test & column.isNotNull()
    return COMPARISONS[operator](natural_key(text(column, kind)), natural_key(F.lit(wanted)))


def literal_text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def finite(column: Column, kind: T.DataType) -> Column:
    """The value where it is a finite number, else null."""
    if not is_number(kind):
        return F.lit(None).cast("double")
    c = column.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def float_text(column: Column) -> Column:
    """A double by 15 significant digits in its shortest form, never with an exponent from 1e-20 up to 1e21."""
    c = F.format_string("%.14e", column.cast("double")).cast("double")
    shape = lambda kind: F.regexp_replace(F.regexp_replace(c.cast("string").cast(kind).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    size = F.abs(c)
    return F.when(c == 0, "0").when((size >= 1) & (size < 1e21), shape("decimal(38,16)")).when((size < 1) & (size >= 1e-20), shape("decimal(38,37)")).otherwise(number_text(c))


def joined_text(*columns: tuple[Column, T.DataType]) -> Column:
    """A formula's ``&``: the values' texts end to end, blanks being empty."""
    return F.concat(*(F.coalesce(text(c, kind), F.lit("")) for c, kind in columns))


def cell_value(value: Column, formula: Column, result: Column) -> Column:
    """A formula's stored result, or the cell's own value."""
    return F.when(formula.isNotNull(), result).otherwise(value)


def projected_value(value: Column, kind: T.DataType, display: Column) -> Column:
    """A value with its display text where that differs from its plain text."""
    return F.struct(value.alias("value"), F.when(~display.eqNullSafe(text(value, kind)), display).alias("display"))
