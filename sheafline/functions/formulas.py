"""Formula text: moving relative references, renaming sheets.

A formula is cut into tokens: strings, quoted sheet names, words (names, numbers,
addresses, with the sheet and the bang before them) and single characters.
Formulas are not evaluated cell by cell here; their aggregates over ranges are
joins (``operators.sheet.range_functions``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions.coordinates import MAX_COLUMNS, MAX_ROWS, address_parts, letters_column

#: A string, a quoted sheet name with its bang, a word, anything else.
TOKEN = """(?s)("(?:""|[^"])*"?|'(?:''|[^'])*'!?|[$.!\\w]+|.)"""


def tokens(formula: Column) -> Column:
    return F.regexp_extract_all(formula, F.lit(TOKEN), F.lit(1))


def shifted(formula: Column, rows: int | Column, columns: int | Column) -> Column:
    """The formula as it reads ``rows`` down and ``columns`` right, numbers or columns; ``$`` pins, strings stay.

    A reference that leaves the sheet becomes an error value.  A function whose name
    reads like an address (``LOG10``) moves like one.
    """

    # a lambda's variable is computed once, a column that it stands for at each use: so each step has its own
    def read(token: Column) -> Column:
        address = F.substring_index(token, "!", -1)
        at = F.when(F.length(address).between(2, 12) & address.rlike(r"^\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6}$"), address_parts(address))
        return F.struct(token.alias("token"), F.substr(token, F.lit(1), F.length(token) - F.length(address)).alias("sheet"), at.alias("at"))

    def moved(t: Column) -> Column:
        at = t["at"]
        column = (at["column"] + F.when(at["pinned_column"], 0).otherwise(columns)).cast("int")
        row = at["row"] + F.when(at["pinned_row"], 0).otherwise(rows)
        return F.struct(t["token"].alias("token"), t["sheet"].alias("sheet"), at.alias("at"), column.alias("column"), row.alias("row"))

    def written(t: Column) -> Column:
        at = t["at"]
        text = F.concat(t["sheet"], F.when(at["pinned_column"], "$").otherwise(""), letters_column(t["column"]), F.when(at["pinned_row"], "$").otherwise(""), t["row"].cast("string"))
        on_sheet = t["column"].between(1, MAX_COLUMNS) & t["row"].between(1, MAX_ROWS)
        return F.when(at.isNull(), t["token"]).when(on_sheet, text).otherwise("#REF!")

    return F.array_join(F.transform(F.transform(F.transform(tokens(formula), read), moved), written), "")


def quoted_sheet(name: str) -> str:
    return "'" + name.replace("'", "''") + "'"


def renamed_sheet(formula: Column, old: str, new: str) -> Column:
    """References to one sheet, quoted or not, under its new name; strings stay."""
    quoted, bare = quoted_sheet(old).lower() + "!", old.lower() + "!"
    plain = old.replace("_", "a").isalnum()

    def renamed(token: Column) -> Column:
        address = F.substring_index(token, "!", -1)
        sheet = F.lower(F.substr(token, F.lit(1), F.length(token) - F.length(address)))
        hit = (F.lower(token) == quoted) | ((sheet == bare) if plain else F.lit(False))
        return F.when(hit, F.concat(F.lit(quoted_sheet(new) + "!"), address)).otherwise(token)

    return F.array_join(F.transform(tokens(formula), renamed), "")
