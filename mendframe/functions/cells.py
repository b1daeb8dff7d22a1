"""Cell functions as Column expressions: predicates, shapes and reversible repairs. None of them runs Python per row.

Every function takes a string column and treats null as the empty string where it says so; a repair gives null where it does
not apply, so that ``coalesce(repair(v), v)`` is the repaired cell.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def cell(c: Column | str) -> Column:
    """A cell as text; null is the empty string."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(c, F.lit(V.SPACE))


def _any(c: Column, markers: tuple[str, ...]) -> Column:
    return reduce(or_, (c.contains(F.lit(m)) for m in markers))


def _whole(body: str, flags: str = "") -> str:
    """A pattern of cells that are as body says, white space at both ends aside; it reads a cell once, where strip() copies it."""
    return rf"{flags}^[{V.SPACE_FAST}]*+(?:{body})[{V.SPACE_FAST}]*+$"


#: Fixed values of the values module as patterns for whole cells.
_PLAIN = _whole(V.PLAIN_NUMBER.removeprefix("^").removesuffix("$"))
_FORMATTED = V.fast(V.FORMATTED_NUMBER)
_EXCEL = _whole(V.EXCEL_DATE.removeprefix("(?i)^").removesuffix("$"), "(?i)")
_NULLS = "|".join(re.sub(r"([^\w/])", r"\\\1", x) for x in V.NULL_LIKE)
_NULL = _whole(_NULLS)
_GENE = _whole(rf"[0-9]{{1,2}}-(?:{'|'.join(sorted({x.split('-')[1] for x in V.GENES}))})")
#: What any repair needs: a comma, the first letter of a marker, a null word or a date.
_TOUCHED = f"{_whole(rf'{_NULLS}|[0-9]{{1,2}}-[A-Z][a-z]{{2}}')}|[,{''.join(sorted({m[0] for m in V.REPAIR_MARKERS}))}]"


def has_mojibake(c: Column) -> Column:
    """Holds one of the 26 markers. The cheap test of four beginnings goes first."""
    pattern = "|".join(V.MOJIBAKE_MARKERS)
    return _any(c, V.REPAIR_MARKERS) & c.rlike(pattern)


def has_stream_mojibake(c: Column) -> Column:
    return _any(c, V.STREAM_MARKERS)


def is_plain_number(c: Column) -> Column:
    return c.rlike(_PLAIN)


def is_formatted_number(c: Column) -> Column:
    """A number that carries display formatting: currency, thousands, parentheses or per cent."""
    return c.rlike(_FORMATTED)


def is_null_like(c: Column) -> Column:
    """Exactly one of the strings that stand for a missing value, as audits see it (unstripped, with NULL())."""
    return c.isin(*V.NULL_LIKE_AUDIT)


def is_excel_date(c: Column) -> Column:
    return c.rlike(_EXCEL)


def is_digits(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+$")


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{V.SPACE_FAST}]")


def control_count(c: Column) -> Column:
    """Undecodable characters of a cell (the replacement mark is an ordinary symbol here)."""
    return F.when(c.rlike(V.CONTROLS), F.regexp_count(c, F.lit(V.CONTROLS))).otherwise(0)


def shape(c: Column, keep_length: bool = False) -> Column:
    """The skeleton of a value: d for digits, a or A for letters (runs count up to four), Mmm for a month, one space for white
    space, any other character as it is. With keep_length runs of digits keep their length."""
    low = [m.lower() for m in V.MONTHS]

    def part(p: Column) -> Column:
        n = F.length(p)
        digits = F.repeat(F.lit("d"), n if keep_length else F.least(n, F.lit(4)))
        first = F.substring(p, 1, 1)
        upper = lambda x: (x == F.upper(x)) & (x != F.lower(x))
        letters = (
            F.when((n == 3) & F.lower(p).isin(*low), "Mmm")
            .when(upper(p), F.repeat(F.lit("A"), F.least(n, F.lit(4))))
            .when(upper(first), F.concat(F.lit("A"), F.repeat(F.lit("a"), F.least(n - 1, F.lit(3)))))
            .otherwise(F.repeat(F.lit("a"), F.least(n, F.lit(4))))
        )
        return F.when(p.rlike(r"^\p{Nd}"), digits).when(p.rlike(r"^\p{L}"), letters).when(p.rlike(f"^[{V.SPACE_FAST}]"), " ").otherwise(p)

    parts = F.regexp_extract_all(strip(c), F.lit(rf"(?s)(\p{{Nd}}+|\p{{L}}+|[{V.SPACE_FAST}]+|.)"), F.lit(1))
    return F.array_join(F.transform(parts, part), "")


# --- repairs: null where they do not apply ---------------------------------------


def fix_mojibake(c: Column) -> Column:
    """Latin-1 text that was UTF-8, read again; only if it decodes and no marker is left."""
    marked = _any(c, V.REPAIR_MARKERS)
    latin = F.when(marked & ~c.rlike(r"[^\x{00}-\x{FF}]"), c)
    fixed = F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    return F.when(marked, F.when((fixed != c) & ~fixed.rlike("|".join(V.REPAIR_MARKERS)), fixed))


def fix_numeric_text(c: Column) -> Column:
    """A plain number without its thousands commas; still a string, so no digit is lost."""
    return F.when(c.contains(",") & is_plain_number(c), F.replace(strip(c), F.lit(","), F.lit("")))


def fix_null_string(c: Column) -> Column:
    return F.when(c.rlike(_NULL), F.lit(""))


def restore_gene(c: Column) -> Column:
    """The gene symbol that a spreadsheet read as a date; exact spelling only."""
    table = F.create_map(*(F.lit(x) for kv in V.GENES.items() for x in kv))
    return F.when(c.rlike(_GENE), F.element_at(table, strip(c)))


def may_change(c: Column) -> Column:
    """Whether any of the repairs, gene symbols included, can apply; most cells need no more than this test."""
    return c.rlike(_TOUCHED)


def pad_digits(c: Column, width: Column) -> Column:
    return F.when(is_digits(c) & (F.length(c) < width), F.lpad(c, width, "0"))


#: The repairs that solve applies to every cell, first match wins; gene symbols come after.
CELL_REPAIRS = (("mojibake", fix_mojibake), ("numeric_as_text", fix_numeric_text), ("null_as_string", fix_null_string))


def repaired(c: Column) -> Column:
    """The first repair that applies."""
    return F.coalesce(*(fix(c) for _, fix in CELL_REPAIRS), c)


def repair_name(c: Column) -> Column:
    """Which repair applies first, or null."""
    return F.coalesce(*(F.when(fix(c).isNotNull(), F.lit(name)) for name, fix in CELL_REPAIRS))
