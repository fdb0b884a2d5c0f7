"""Links, references, codecs and number display, as native expressions."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_xml(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def unescape_xml(c: Column) -> Column:
    for raw, name in (("'", "&apos;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(name), F.lit(raw))
    return c


def target_kind(c: Column) -> Column:
    """external (has a scheme, drive letters apart), anchor, or relative."""
    drive = c.rlike(r"^[A-Za-z]:[\\/]")
    return F.when(F.startswith(c, F.lit("#")), "anchor").when(~drive & c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "external").otherwise("relative")


def markdown_url(c: Column) -> Column:
    """A link target: angle brackets and bars encoded, wrapped where it has spaces or parentheses."""
    out = c
    for raw, code in (("<", "%3C"), (">", "%3E"), ("|", "%7C")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    out = F.regexp_replace(out, r"[\x00-\x1f\x7f]", "")
    return F.when(out.rlike(r"[ ()]"), F.concat(F.lit("<"), out, F.lit(">"))).otherwise(out)


def canonical_base64(c: Column) -> Column:
    """Bytes of base64 text that is canonical (encodes back to itself), else null."""
    data = F.try_to_binary(c, F.lit("base64"))
    return F.when(F.replace(F.base64(data), F.lit("\r\n"), F.lit("")) == c, data)


def normal_sha256(c: Column) -> Column:
    """64 lower-case hex digits, without the prefix; null for anything else."""
    hexed = F.lower(F.regexp_replace(F.trim(c), "(?i)^sha256:", ""))
    return F.when(hexed.rlike("^[0-9a-f]{64}$"), hexed)


#: Sizes of doubles: those whose shortest text may lack digits begin with the first; the second is the first beyond a long, in steps of the third.
LONG, WHOLE, STEP = 2.0**40, 2.0**63, 2.0**11


def all_digits(size: Column, decimals: int) -> Column:
    """A size from 0 with thousands and decimals, rounded half to even; large ones below 2 ** 74 with every digit they have."""
    low = F.floor(size)
    part = F.format_number(size - low, decimals)  # 1 if it is rounded up
    if decimals:
        exact = F.concat(F.format_number(low + F.substring(part, 1, 1).cast("long"), 0), F.substring(part, 2, decimals + 1))
    else:
        exact = F.format_number(F.rint(size).cast("long"), 0)
    huge = F.format_number(F.floor(size / STEP).cast("decimal(38,0)") * F.lit(Decimal(int(STEP))), decimals)
    return F.when((size >= LONG) & (size < WHOLE), exact).when((size >= WHOLE) & (size < WHOLE * STEP), huge).otherwise(F.format_number(size, decimals))


def number_display(value: Column, decimals: int = 0, grouping: bool = False, percent: bool = False, accounting: bool = False) -> Column:
    """A number under a simple format: decimals, thousands, per cent, parentheses for negatives."""
    scaled = F.abs(value * 100 if percent else value)
    digits = all_digits(scaled, decimals)
    digits = digits if grouping else F.replace(digits, F.lit(","), F.lit(""))
    body = F.concat(digits, F.lit("%" if percent else ""))
    negative = F.concat(F.lit("("), digits, F.lit(")"), F.lit("%" if percent else "")) if accounting else F.concat(F.lit("-"), body)
    return F.when(value < 0, negative).otherwise(body)


def table_line(*cells: Column) -> Column:
    """One line of a Markdown table; bars are escaped and line ends become breaks."""
    shown = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", "<br>") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def decoded_component(c: Column) -> Column:
    """Per cent escapes as the bytes they stand for; what is no UTF-8 then becomes replacement characters, plus signs stay."""
    pieces = F.regexp_extract_all(c, F.lit("((?:%[0-9A-Fa-f]{2})+|[^%]+|%)"), F.lit(1))
    digits = F.transform(pieces, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}"), F.replace(p, F.lit("%"), F.lit(""))).otherwise(F.hex(p)))
    return F.make_valid_utf8(F.unhex(F.array_join(digits, "")).cast("string"))


#: Media types of embedded pictures by extension.
MEDIA = {"bmp": "image/bmp", "emf": "image/emf", "gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "wmf": "image/wmf"}


def media_type(extension: Column) -> Column:
    pairs = [F.lit(x) for item in MEDIA.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(extension)), F.lit("application/octet-stream"))


def resolved_path(base: Column, target: Column) -> Column:
    """A part's path relative to another part's folder; ``..`` stops at the root."""
    folder = F.when(F.startswith(target, F.lit("/")), F.lit("")).otherwise(F.regexp_replace(base, r"[^/]*$", ""))
    steps = F.split(F.concat(folder, F.regexp_replace(target, r"#.*$", "")), "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        steps, empty,
        lambda done, s: F.when((s == "") | (s == "."), done).when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(empty)).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(kept, "/")


def duration_clock(c: Column) -> Column:
    """An ISO 8601 duration of days, hours, minutes and seconds as a clock; others stay as they are."""
    shape = r"^(-?)P(?:(\d{1,6})D)?(?:T(?:(\d{1,6})H)?(?:(\d{1,6})M)?(?:(\d{1,6})(?:\.\d+)?S)?)?$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, shape, k), F.lit("")).cast("long"), F.lit(0))
    total = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    clock = F.format_string("%s%02d:%02d:%02d", F.regexp_extract(c, shape, 1), F.floor(total / 3600).cast("long"), F.floor(F.pmod(total, F.lit(3600)) / 60).cast("long"), F.pmod(total, F.lit(60)))
    return F.when(c.rlike(shape) & c.rlike(r"\d"), clock).otherwise(c)


def escaped_text(c: Column, line_start: bool = True, label: bool = False, cell: bool = False, open_end: bool = False) -> Column:
    """Text that Markdown shows as it is, with a backslash only where a character could be syntax.

    Marks of emphasis count if one of their kind follows and no space does, ``_``
    not between letters; brackets if they may close; heading, list, quote and rule
    marks at a line's start, where the text begins one if ``line_start``.  In a
    ``label`` all brackets count, in a table ``cell`` all bars.  With an ``open_end``
    markup follows, so a mark may find its partner there.
    """
    out = F.regexp_replace(c, r"&(?=#|[0-9A-Za-z]+;)", "&amp;")
    tail = r"|\z" if open_end else ""
    later = lambda mark: rf"(?=[^{mark}]*{mark}{'|' if open_end else ''})"
    space = lambda after: rf"(?=\S{tail}){after}"
    marks = [
        r"\\", "`" + later("`"), r"\*" + space(later(r"\*")), "~" + space(later("~")), "_" + space(later("_")) + r"(?:(?<![\p{L}\p{N}]_)|(?![\p{L}\p{N}]))",
        r"[\[\]]" if label else r"\[" + later(r"\]"), "<(?=[A-Za-z/!?])", *([r"\|"] if cell else []), *([r"!\z"] if open_end else []),
    ]
    out = F.regexp_replace(out, f"(?U)(?:{'|'.join(marks)})", r"\\$0")
    # marks that make a line's first word a block; spaces before it are kept
    begin = r"(?dUm)^([^\S\n]*)" if line_start else r"(?dUm)(?<=\n)([^\S\n]*)"
    over = r"(?=\s)" if open_end else r"(?=\s|\z)"
    blocks = [r"#+" + over, f"[-+]{over}", rf"-(?=[- \t]*(?:\n|\z))", rf"=(?=[= \t]*(?:\n|\z))", ">", r"\*"]
    out = F.regexp_replace(out, f"{begin}({'|'.join(blocks)})", r"$1\\$2")
    return F.regexp_replace(out, rf"{begin}([0-9]+)([.)])(?=\s|\z)", r"$1$2\\$3")


def url_as_text(c: Column) -> Column:
    """A link target shown as a link's text."""
    return escaped_text(F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", " "), line_start=False, label=True, open_end=True)


def code_span(c: Column) -> Column:
    """Inline code, in a fence longer than any run of backticks in it; padded where it starts or ends with one."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length)
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(c.rlike("^`|`$"), " ").otherwise("")
    return F.concat(fence, pad, c, pad, fence)


def format_sections(pattern: str) -> list[list[tuple[str, str]]]:
    """A number format's sections as ``(kind, text)``: literals in their places, and the pattern's own characters.

    Quoted text, escaped characters and what no pattern uses are literals; colours
    and conditions in brackets go, as do the widths and fills of ``_x`` and ``*x``.
    """
    token = re.compile(r""""((?:[^"]|"")*)"?|\\(.)|_.?|\*.?|\[[^\]]*\]?|(;)|(am/pm|a/p)|([dmyhs]+|[0#?.,%]+)|(.)""", re.IGNORECASE | re.DOTALL)
    sections: list[list[tuple[str, str]]] = [[]]
    for m in token.finditer(pattern):
        quoted, escaped, end, half, own, other = m.groups()
        if end:
            sections.append([])
        elif half:
            sections[-1].append(("half", half))
        elif own:
            # a run of different date letters is several parts
            sections[-1] += [("code", run[0]) for run in re.finditer(r"([dmyhsDMYHS])\1*|[0#?.,%]+", own)]
        elif (text := (quoted or "").replace('""', '"') + (escaped or "") + (other or "")) != "":
            joined = sections[-1].pop()[1] if sections[-1] and sections[-1][-1][0] == "text" else ""
            sections[-1].append(("text", joined + text))
    return sections


#: What a date format's parts mean, as Spark names them.
DATE_PARTS = {"yyyy": "yyyy", "yy": "yy", "y": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "hh": "HH", "h": "H", "ss": "ss", "s": "s"}


def date_pattern(section: list[tuple[str, str]]) -> str:
    """A date section in Spark's letters: ``m`` after an hour or before a second is minutes."""
    codes = [t.lower() if k == "code" else "" for k, t in section]
    halves = any(k == "half" for k, _ in section)
    places = [i for i, t in enumerate(codes) if t[:1] in tuple("dmyhs")]
    out = []
    for i, (kind, text) in enumerate(section):
        if i not in places:
            shown = "a" if kind == "half" else "'" + text.replace("'", "''") + "'"
        else:
            at, code = places.index(i), codes[i]
            near = [codes[places[k]] for k in (at - 1, at + 1) if 0 <= k < len(places)]
            before, after = (near[0] if at else ""), (near[-1] if at + 1 < len(places) else "")
            minutes = code in ("m", "mm") and (before[:1] == "h" or after[:1] == "s")
            shown = code if minutes else DATE_PARTS.get(code, DATE_PARTS["yyyy"] if code[0] == "y" else DATE_PARTS[code[0] * min(len(code), 4 if code[0] in "md" else 2)])
            shown = shown.replace("H", "h") if halves else shown
        out.append(shown)
    return "".join(out)


def serial_display(value: Column, pattern: str) -> Column:
    """A serial day number under a date pattern, to the nearest second; null outside the calendar."""
    from sheafline.functions.text import serial_to_date

    seconds = F.round(value * 86_400).cast("long")
    day = serial_to_date(F.floor(seconds / 86_400).cast("double"))
    at = F.timestamp_add("SECOND", F.pmod(seconds, F.lit(86_400)).cast("int"), day.cast("timestamp_ntz"))
    return F.date_format(at, pattern)


def number_section(value: Column, section: list[tuple[str, str]]) -> Column:
    """A number's size in a section: digits where the pattern has them, literals in their places around them."""
    codes = [i for i, (kind, _) in enumerate(section) if kind == "code"]
    digits = [i for i in codes if re.search("[0#?]", section[i][1])]
    own = "".join(section[i][1] for i in codes)
    if not digits:
        return F.lit("".join(t for k, t in section if k == "text") + ("%" if "%" in own else ""))
    whole, _, part = own.replace("%", "").partition(".")
    scaled = F.abs(value * 100 if "%" in own else value)
    shown = all_digits(scaled, sum(ch in "0#?" for ch in part))
    shown = shown if "," in whole else F.replace(shown, F.lit(","), F.lit(""))
    least = whole.count("0") + (len(part) + 1 if part else 0)
    shown = F.when(F.length(shown) < least, F.lpad(shown, least, "0")).otherwise(shown) if whole.count("0") > 1 and "," not in whole else shown
    before = "".join(t for k, t in section[: digits[0]] if k == "text")
    after = "".join(t if k == "text" else "%" if "%" in t else "" for k, t in section[digits[0] :])
    return F.concat(F.lit(before), shown, F.lit(after))


def formatted(value: Column, pattern: str) -> Column:
    """A number under a format string: sections for positive, negative and zero, decimals, thousands, per cent, literals, dates and times.

    ``General``, an empty format and ``@`` show the number's own text, as do dates
    outside the calendar.  A negative number has its sign unless it has a section of
    its own.
    """
    from sheafline.functions.values import number_text

    if pattern.strip().lower() in ("", "general", "@"):
        return number_text(value)
    sections = format_sections(pattern)
    letters = {t[0].lower() for k, t in sections[0] if k == "code"}
    if letters & set("dyhs") and not letters & set("0#?"):
        return F.coalesce(serial_display(value, date_pattern(sections[0])), number_text(value))
    positive = number_section(value, sections[0])
    negative = number_section(value, sections[1]) if len(sections) > 1 else F.concat(F.lit("-"), positive)
    zero = number_section(value, sections[2]) if len(sections) > 2 else positive
    return F.when(value < 0, negative).when(value == 0, zero).otherwise(positive)
