"""A1 addresses: column letters, cell and range references."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384
CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?(\d{1,7})")


def letters(number: int) -> str:
    """Column letters of a 1-based number."""
    out = ""
    while number > 0:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def parse_cell(address: str) -> tuple[int, int]:
    """(row, column) of an A1 address; dollar signs are ignored."""
    found = CELL.fullmatch(address.strip())
    if not found:
        raise ValueError(f"not a cell address: {address}")
    column = 0
    for c in found[1].upper():
        column = 26 * column + ord(c) - 64
    row = int(found[2])
    if not (1 <= row <= MAX_ROWS and 1 <= column <= MAX_COLUMNS):
        raise ValueError(f"outside the sheet: {address}")
    return row, column


def parse_range(address: str) -> tuple[int, int, int, int]:
    """(top, left, bottom, right), oriented."""
    start, _, end = address.partition(":")
    (r1, c1), (r2, c2) = parse_cell(start), parse_cell(end or start)
    return min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)


def letters_column(number: Column) -> Column:
    """Column letters of a number column, up to three letters."""
    n = number.cast("int")
    one = F.pmod(n - 1, F.lit(26))
    two = F.floor((n - 1) / 26).cast("int")
    three = F.floor((two - 1) / 26).cast("int")
    letter = lambda k: F.char(65 + k)
    return F.concat(
        F.when(three > 0, letter(F.pmod(three - 1, F.lit(26)))).otherwise(""),
        F.when(two > 0, letter(F.pmod(two - 1, F.lit(26)))).otherwise(""),
        letter(one),
    )


def address_column(row: Column, column: Column) -> Column:
    return F.concat(letters_column(column), row.cast("string"))


def column_number(name: Column) -> Column:
    """Number of column letters."""
    chars = F.split(F.upper(name), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c == "", a).otherwise(26 * a + F.ascii(c) - 64))


def address_parts(c: Column) -> Column:
    """``pinned_column, column, pinned_row, row`` of an A1 address; null for any other text."""
    bare = F.replace(c, F.lit("$"), F.lit(""))
    name = F.regexp_extract(bare, "^[A-Za-z]+", 0)
    number = F.substr(bare, F.length(name) + 1)
    pinned_column, pinned_row = F.startswith(c, F.lit("$")), F.contains(F.substr(c, F.lit(2)), F.lit("$"))
    mark = lambda pinned: F.when(pinned, "$").otherwise("")
    shaped = F.length(name).between(1, 3) & number.rlike("^[1-9][0-9]{0,6}$") & (F.concat(mark(pinned_column), name, mark(pinned_row), number) == c)
    parts = F.struct(pinned_column.alias("pinned_column"), column_number(name).alias("column"), pinned_row.alias("pinned_row"), F.try_to_number(number, F.lit("9999999")).cast("long").alias("row"))
    return F.when(shaped, parts)
