"""Text clean-up, slugs, list markers and value kinds, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Line ends to one space, no-break space to space; invisible and control characters go.

    Tabs and zero-width (non-)joiners stay.
    """
    c = F.regexp_replace(c, "\r\n|\r|\n", " ")
    c = F.regexp_replace(c, " ", " ")
    return F.regexp_replace(c, "[­​﻿\u0000-\u0008\u000b-\u001f\u007f-\u009f]", "")


def collapse_space(c: Column) -> Column:
    """Runs of white space to one space; ends are not trimmed."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def fold(c: Column) -> Column:
    return F.lower(F.trim(c))


def heading_slug(c: Column) -> Column:
    """Anchor of a heading: lower case letters, digits, marks, connectors, hyphens."""
    kept = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\p{M}\p{Pc} -]", "")
    slug = F.translate(kept, " ", "-")
    return F.when(slug == "", "section").otherwise(slug)


def anchor_id(c: Column) -> Column:
    """Identifier of ``[a-z0-9_-]`` with single, inner dashes."""
    dashed = F.regexp_replace(F.lower(c), r"[^a-z0-9_-]", "-")
    trimmed = F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")
    return F.when(trimmed == "", "anchor").otherwise(trimmed)


def backtick_fence(c: Column) -> Column:
    """A fence of backticks longer than any run in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def safe_url(c: Column) -> Column:
    """Whether a link uses http, https, mailto or tel."""
    return F.trim(c).rlike("(?i)^(https?|mailto|tel):")


def file_name(c: Column) -> Column:
    """A name without controls and slashes, of at most 240 characters."""
    out = F.substring(F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f/\\]", "_")), 1, 240)
    return F.when(out == "", "document").otherwise(out)


def alpha_marker(n: Column) -> Column:
    """a, b, ... z, aa, ab, ...: bijective base 26, up to three letters."""
    from sheafline.functions.coordinates import letters_column

    return F.lower(letters_column(n))


#: The Roman numerals' parts.
ROMAN = (
    ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"),
    ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"),
    ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"),
    ("", "m", "mm", "mmm"),
)


def roman_marker(n: Column) -> Column:
    """Lower-case Roman numeral of 1 to 3999, else the decimal number."""
    digit = lambda place: F.pmod(F.floor(n / 10**place).cast("int"), F.lit(10))
    pick = lambda place: F.get(F.array(*map(F.lit, ROMAN[place])), digit(place))
    return F.when(n.between(1, 3999), F.concat(F.coalesce(pick(3), F.lit("")), pick(2), pick(1), pick(0))).otherwise(n.cast("string"))


def marker_ordinal(kind: Column, n: Column) -> Column:
    """An ordinal in a marker's form: bullet, decimal, lower-alpha, upper-alpha, lower-roman or upper-roman."""
    alpha = F.when(n > 0, alpha_marker(n)).otherwise("0")
    roman = roman_marker(n)
    return F.when(kind == "bullet", "-").when(kind == "lower-alpha", alpha).when(kind == "upper-alpha", F.upper(alpha)).when(kind == "lower-roman", roman).when(kind == "upper-roman", F.upper(roman)).otherwise(n.cast("string"))


def value_kind(c: Column) -> Column:
    """What a text looks like: blank, number, date, clock time, boolean or text."""
    t = F.trim(c)
    return (
        F.when(t.isNull() | (t == ""), "blank")
        .when(t.rlike(r"^[-+]?[$€£]?[0-9][0-9,]*(\.[0-9]+)?%?$"), "number")
        .when(t.rlike(r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}$"), "date")
        .when(t.rlike(r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"), "time")
        .when(F.lower(t).isin("true", "false"), "boolean")
        .otherwise("text")
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))


#: File extensions and the format each stands for.
EXTENSIONS = {
    "csv": "csv", "doc": "doc", "docm": "docx", "docx": "docx", "epub": "epub", "odp": "odp", "ods": "ods", "odt": "odt",
    "pdf": "pdf", "ppt": "ppt", "pptm": "pptx", "pptx": "pptx", "rtf": "rtf", "xls": "excel", "xlsb": "excel", "xlsm": "excel", "xlsx": "excel",
}


def format_of(path: Column) -> Column:
    """The document format that a path's extension stands for, or null."""
    pairs = [F.lit(x) for item in EXTENSIONS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def serial_to_date(serial: Column, epoch_1904: bool = False) -> Column:
    """Date of a spreadsheet serial number; null outside 0 to 2,958,465.

    In the 1900 system serials below 60 are one day off, as 1900 counts as a leap year.
    """
    base = F.lit("1904-01-01" if epoch_1904 else "1899-12-30").cast("date")
    days = F.floor(serial).cast("int")
    days = days if epoch_1904 else F.when(serial < 60, days + 1).otherwise(days)
    return F.when(serial.between(0, 2_958_465), F.date_add(base, days))


def clock_of_days(days: Column) -> Column:
    """A duration in days as hours (any number), minutes and seconds."""
    total = F.round(F.abs(days) * 86400).cast("long")
    parts = F.format_string("%d:%02d:%02d", F.floor(total / 3600).cast("long"), F.floor(F.pmod(total, F.lit(3600)) / 60).cast("long"), F.pmod(total, F.lit(60)))
    return F.when(days < 0, F.concat(F.lit("-"), parts)).otherwise(parts)


# Media types of zipped documents.
CONTAINERS = {
    "application/epub+zip": "epub",
    "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/vnd.oasis.opendocument.presentation": "odp",
}


def container_format(mime: Column) -> Column:
    """The format that a zipped document's own media type names; templates are of their document's format."""
    base = F.regexp_replace(F.trim(mime), "-template$", "")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CONTAINERS.items() for x in pair)), base)


def time_of_day(days: Column) -> Column:
    """A fraction of a day as ``hh:mm:ss``."""
    seconds = F.pmod(F.floor(F.abs(days) * 86400 + 0.5).cast("long"), F.lit(86400))
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)))
