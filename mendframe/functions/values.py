"""Fixed values that results depend on: markers, word lists, patterns, limits and thresholds."""

from __future__ import annotations

# What Python's str.strip and \s take as white space.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: The same as the inside of a character class that Java and RE2 read alike.
SPACE_CLASS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same for Java alone: low characters by a table, high ones behind one test. Java asks each range of a plain class in turn, at up to 16 times the time.
SPACE_FAST = "".join(rf"\x{{{ord(x):02x}}}" for x in SPACE if x < "\xff") + r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"


def fast(pattern: str) -> str:
    """A pattern with the class of white space as Java reads it fastest."""
    return pattern.replace(SPACE_CLASS, SPACE_FAST)


# UTF-8 read as Latin-1 or Windows-1252.
MOJIBAKE_MARKERS = (
    "Ã¡", "Ã©", "Ã\xad", "Ã³", "Ãº", "Ã±", "Ã¼", "Ã¤", "Ã¶", "Ã ", "Ã¨", "â€™",
    "â€œ", "â€", "â€“", "â€”", "â€¦", "Â£", "Â©", "Â®", "Â°", "Â ", "Ã‰", "Ã–",
    "Ãœ", "ï»¿",
)
#: The wider markers that repair and streaming look for.
REPAIR_MARKERS = ("Ã", "Â", "â€", "ï»¿")
STREAM_MARKERS = (*REPAIR_MARKERS, "�")

# Strings that stand for a missing value.
NULL_LIKE = ("null", "NULL", "Null", "n/a", "N/A", "NA", "na", "none", "None", "NONE", "-", "--", "?", "nan", "NaN", "#N/A", "#NULL!", "\\N")
NULL_LIKE_AUDIT = (*NULL_LIKE, "NULL()")

# Patterns, written so that Java and RE2 read them alike.
PLAIN_NUMBER = r"^[+-]?(\p{Nd}{1,3}(,\p{Nd}{3})*|\p{Nd}+)(\.\p{Nd}+)?([eE][+-]?\p{Nd}+)?$"
_S = f"[{SPACE_CLASS}]"
FORMATTED_NUMBER = (
    rf"^{_S}*([-+]?[$£€¥]{_S}?[\p{{Nd}},]+(\.\p{{Nd}}+)?"
    rf"|[-+]?\p{{Nd}}{{1,3}}(,\p{{Nd}}{{3}})+(\.\p{{Nd}}+)?"
    rf"|\({_S}*[$£€¥]?[\p{{Nd}},]+(\.\p{{Nd}}+)?{_S}*\)"
    rf"|[-+]?[\p{{Nd}},]+(\.\p{{Nd}}+)?{_S}?%){_S}*$"
)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
EXCEL_DATE = r"(?i)^\p{Nd}{1,2}-(" + "|".join(MONTHS) + ")$"
ID_NAME = r"(?i)(id|code|zip|postal|account|sku|part|ref)$"
CID = r"\(cid:\p{Nd}+\)"
WORD = r"[A-Za-z][A-Za-z'-]*"
#: Characters that no decoder should leave in a text, and the replacement mark; tabs and line ends are not among them.
UNDECODED = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\p{Cf}\p{Co}\x{fffd}]"
#: The same for Java alone, as with SPACE_FAST.
UNDECODED_FAST = "[" + "".join(rf"\x{{{i:02x}}}" for i in (*range(9), 11, 12, *range(14, 32), *range(127, 160))) + r"[\x{ad}-\x{10ffff}&&[\p{Cf}\p{Co}\x{fffd}]]]"
CONTROLS = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\p{Cf}\p{Co}]"

# Short words of ordinary English.
SHORT_WORDS = tuple(
    """a i an as at be by do go he if in is it me my no of on or so to up us we am the and for was are but not you all can had her his its
    our out she who did has this that with from they have been were will more when what your than them then et al ie eg vs pp ed fig ref
    eq cf ca vol""".split()
)

# Gene symbols by what a spreadsheet made of them.
GENES = {
    "1-Mar": "MARCH1", "2-Mar": "MARCH2", "3-Mar": "MARCH3", "4-Mar": "MARCH4", "5-Mar": "MARCH5", "6-Mar": "MARCH6", "7-Mar": "MARCH7", "8-Mar": "MARCH8",
    "9-Mar": "MARCH9", "10-Mar": "MARCH10", "11-Mar": "MARCH11",
    "1-Sep": "SEPT1", "2-Sep": "SEPT2", "3-Sep": "SEPT3", "4-Sep": "SEPT4", "5-Sep": "SEPT5", "6-Sep": "SEPT6", "7-Sep": "SEPT7", "8-Sep": "SEPT8",
    "9-Sep": "SEPT9", "10-Sep": "SEPT10", "11-Sep": "SEPT11", "12-Sep": "SEPT12", "14-Sep": "SEPT14", "15-Sep": "SEPT15",
    "1-Dec": "DEC1", "2-Dec": "DEC2",
    "1-Oct": "OCT1", "2-Oct": "OCT2", "3-Oct": "OCT3", "4-Oct": "OCT4", "6-Oct": "OCT6", "11-Oct": "OCT11",
}

# Field lengths at which other systems cut.
LENGTH_LIMITS = (50, 100, 128, 200, 255, 256, 500, 512, 1000, 1024)

# Thresholds.
THRESHOLDS = {
    "mojibake_suspect": 0.002,
    "mojibake_corrupt": 0.02,
    "numeric_as_text": 0.95,
    "ragged_suspect": 0.001,
    "ragged_corrupt": 0.01,
    "truncation": 0.03,
    "truncation_diversity": 0.30,
    "null_string": 0.01,
    "excel_date": 2.0,
    "leading_zero": 0.5,
    "min_rows": 30,
    "shattered_suspect": 0.05,
    "shattered_corrupt": 0.25,
    "numeric_loss_suspect": 0.004,
    "numeric_loss_corrupt": 0.0005,
    "glyph_suspect": 0.5,
    "glyph_corrupt": 3.0,
    "min_tokens": 200,
    "dominance": 0.90,
    "max_anomaly": 0.05,
    "min_values": 40,
    "isolation": 3,
}

# Weights of each mode for each use; a mode that isn't named weighs 1.
USES = ("search_index", "analytics", "joins", "scientific", "archive", "classification")
WEIGHTS = {
    "mojibake": (1, 0.5, 2, 0.5, 2, 0),
    "numeric_as_text": (0, 2, 1, 1, 1, 0),
    "truncation": (0.5, 1, 2, 2, 2, 0),
    "null_as_string": (0.5, 2, 1, 1, 1, 0),
    "excel_date_corruption": (0, 1, 1, 2, 2, 0),
    "leading_zero_loss": (0, 1, 2, 2, 2, 0),
    "ragged_rows": (1, 2, 2, 2, 2, 1),
    "duplicate_columns": (1, 2, 2, 2, 2, 0.5),
    "missing_glyph": (2, 0.5, 0, 1, 2, 0.5),
    "shattered_words": (2, 0, 0, 0.5, 2, 0.5),
    "numeric_loss": (0, 2, 0.5, 2, 2, 0),
}

# Modes that no repair undoes.
IRRECOVERABLE = ("excel_date_corruption", "truncation", "numeric_loss", "missing_glyph", "shattered_words", "ragged_rows")

# Learning and mining.
MIN_LABELS, MIN_PER_CLASS, MIN_GAIN = 40, 10, 0.03
MIN_SUPPORT, MIN_PRECISION, MIN_LIFT, MAX_LIFT, USELESS_AFTER = 8, 0.85, 4.0, 999.0, 30
CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Co")
