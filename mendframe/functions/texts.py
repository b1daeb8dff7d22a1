"""Text functions as Column expressions: rates that tell a damaged extraction from prose, and features that rules are mined from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

TOKEN = f"[^{V.SPACE_FAST}]+"
#: From a token's first digit to its end: as many matches as tokens with a digit, and no letter is read twice.
DIGIT_TOKEN = rf"\p{{Nd}}[^{V.SPACE_FAST}]*+"


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN)).cast("long")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(V.WORD), F.lit(0))


def glyph_rate(c: Column) -> Column:
    """Undecodable characters and (cid:n) marks per 1000 characters; 0 for an empty text."""
    bad = F.regexp_count(c, F.lit(V.UNDECODED_FAST)) + F.when(c.contains("(cid:"), F.regexp_count(c, F.lit(V.CID))).otherwise(0)
    return F.coalesce(F.try_divide(bad.cast("double"), F.length(c).cast("double")) * 1000, F.lit(0.0))


def code_point(c: Column) -> Column:
    """U+ and the code point of a character, four hex digits at least."""
    return F.concat(F.lit("U+"), F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0{1,4}", ""))


def glyph_samples(c: Column, most: int = 8) -> Column:
    """(cid:n) marks as they come, then code points of undecodable characters, each once."""
    marks = F.regexp_extract_all(c, F.lit(V.CID), F.lit(0))
    chars = F.array_distinct(F.regexp_extract_all(c, F.lit(V.UNDECODED), F.lit(0)))
    named = F.transform(chars, code_point)
    return F.slice(F.concat(marks, named), 1, most)


def fragment_mask(c: Column) -> Column:
    """One letter a word: F for a short word that is no ordinary one, a dot for any other."""
    stop = V.SHORT_WORDS
    return F.array_join(F.transform(words(c), lambda w: F.when((F.length(w) <= 4) & ~F.lower(w).isin(*stop), "F").otherwise(".")), "")


def fragment_ratio(mask: Column) -> Column:
    """Share of words in runs of three fragments or more; 0 for under 200 words."""
    n = F.length(mask)
    inside = n - F.length(F.regexp_replace(mask, "F{3,}", ""))
    return F.when(n >= V.THRESHOLDS["min_tokens"], inside.cast("double") / n).otherwise(0.0)


def fragment_samples(c: Column, mask: Column, most: int = 6) -> Column:
    """The first runs of fragments, words joined by a space."""
    w = words(c)
    at = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(mask), F.lit(1))),
        lambda i: (F.substring(mask, i, F.lit(3)) == "FFF") & ((i == 1) | (F.substring(mask, i - 1, F.lit(1)) != "F")),
    )
    run = lambda i: F.length(F.regexp_extract(F.substring(mask, i, F.length(mask)), "^F+", 0))
    return F.transform(F.slice(at, 1, most), lambda i: F.array_join(F.slice(w, i, run(i)), " "))


def digit_rate(c: Column, tokens: Column) -> Column:
    """Share of tokens that hold a digit; -1 for under 200 tokens."""
    with_digit = F.regexp_count(c, F.lit(DIGIT_TOKEN))
    return F.when(tokens >= V.THRESHOLDS["min_tokens"], with_digit.cast("double") / tokens).otherwise(-1.0)


# --- features that rules are mined from -------------------------------------------


def _let(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Plain letters and blanks, most of most texts: counted by three passes and taken out before other categories are counted.
_PLAIN = (("Ll", "[a-z]+"), ("Lu", "[A-Z]+"), ("Zs", " +"))


def char_classes(c: Column) -> Column:
    """map of Unicode category -> rate per 1000 characters, categories that occur only."""
    plain = dict(_PLAIN)
    rest = lambda x: F.regexp_replace(x, "[a-zA-Z ]+", "")

    def rates(x: Column) -> Column:
        n = F.length(x["all"]).cast("double")
        kept = lambda k: F.length(x["all"]) - F.length(F.regexp_replace(x["all"], plain[k], "")) if k in plain else F.lit(0)
        count = lambda k: F.length(x["rest"]) - F.length(F.regexp_replace(x["rest"], rf"\p{{{k}}}+", "")) + kept(k)
        every = F.array(*(F.struct(F.lit(k).alias("key"), (F.try_divide(count(k).cast("double"), n) * 1000).alias("value")) for k in V.CATEGORIES))
        return F.map_from_entries(F.filter(every, lambda r: r["value"] > 0))  # null rates, of empty texts, are left out

    return _let(F.struct(c.alias("all"), rest(c).alias("rest")), rates)


_SPACE, _INK = f"[{V.SPACE_FAST}]", f"[^{V.SPACE_FAST}]"
#: Letters that upper case changes: with one of them a token isn't in capitals.
_SMALL = "".join(rf"\x{{{i:02x}}}" for i in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))) + r"[\x{3b1}-\x{44f}&&[\x{3b1}-\x{3c9}\x{430}-\x{44f}]]"
_TALL = f"[^{V.SPACE_FAST}{_SMALL}]{{3,}}+(?!{_INK})"
#: Four tokens or more that may be in capitals; only these are looked at one by one.
CAPS = f"(?<!{_INK}){_TALL}(?:{_SPACE}++{_TALL}){{3,}}+"
#: Letters of these two scripts are what a token of mixed scripts has at least one of.
_OTHER = r"[\x{370}-\x{10ffff}&&[\p{IsCyrillic}\p{IsGreek}]&&\p{L}]"


def token_shapes(c: Column) -> Column:
    """Which of the five structural shapes a text shows."""
    split = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    upper = lambda t: (t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) > 2)
    caps = lambda run: F.array_join(F.transform(split(run), lambda t: F.when(upper(t), "C").otherwise(".")), "").contains("CCCC")
    scripts = lambda t: sum((t.rlike(rf"[\p{{{s}}}&&\p{{L}}]").cast("int") for s in ("IsLatin", "IsCyrillic", "IsGreek")), F.lit(0))
    shown = [
        ("ISOLATED_LETTER", c.rlike(rf"(?<!{_INK})\p{{L}}(?!{_INK})")),
        ("ALLCAPS_RUN", F.exists(F.regexp_extract_all(c, F.lit(CAPS), F.lit(0)), caps)),
        ("REPEATED_CHAR", c.rlike(rf"({_INK})\1{{3,}}")),
        ("REPEATED_PUNCT", c.rlike("[.,;:]{2,}")),
        ("MIXED_SCRIPT", F.when(c.rlike(_OTHER), F.exists(split(c), lambda t: scripts(t) > 1))),
    ]
    return F.array_compact(F.array(*(F.when(on, name) for name, on in shown)))


#: The commonest letters, digits and spaces by a table, before categories are asked for.
_COMMON = "".join(rf"\x{{{i:02x}}}" for i in (9, 10, 13, 32, *range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B)))


def markers(c: Column, longest: int = 6) -> Column:
    """Punctuation runs of 2 to ``longest``, the mark (cid:, and undecodable characters by code point; each once."""
    runs = F.regexp_extract_all(c, F.lit(rf"[[^{_COMMON}]&&[^\p{{L}}\p{{N}}_{V.SPACE_FAST}]]{{2,{longest}}}"), F.lit(0))
    cid = F.array_compact(F.array(F.when(c.rlike(V.CID), "(cid:")))
    chars = F.array_distinct(F.regexp_extract_all(c, F.lit(V.CONTROLS), F.lit(0)))
    named = F.transform(chars, code_point)
    return F.array_distinct(F.concat(runs, cid, named))
