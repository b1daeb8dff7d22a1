"""Cell functions against small Python oracles written from the rules."""

import pytest
from pyspark.sql import functions as F

from mendframe.functions import cells as C
from mendframe.functions import texts as T
from mendframe.functions import values as V


def apply(spark, fn, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def mangled(x: str) -> str:
    return x.encode().decode("latin-1")


def test_fixed_values():
    assert len(V.MOJIBAKE_MARKERS) == 26 and len(V.GENES) == 33 and V.GENES["2-Sep"] == "SEPT2" and V.GENES["11-Mar"] == "MARCH11"
    assert V.GENES["1-Dec"] == "DEC1" and "13-Sep" not in V.GENES and "5-Oct" not in V.GENES


def test_mojibake(spark):
    items = [mangled("José"), "José", mangled("naïve café"), "plain", "", "\xe2€™", "\xc3 \xc3", mangled(mangled("é")), None]
    assert apply(spark, C.fix_mojibake, items) == ["José", None, "naïve café", None, None, None, None, None, None]
    assert apply(spark, C.has_mojibake, items[:6]) == [True, False, True, False, False, True]


def test_numbers(spark):
    items = ["1,234", " 1,234.50 ", "12,34", "1234", "$1,234", "1,234,567e3", "(1,234)", "12.5%", "-1,000", "", "abc", "1,234x"]
    assert apply(spark, C.fix_numeric_text, items) == ["1234", "1234.50", None, None, None, "1234567e3", None, None, "-1000", None, None, None]
    assert apply(spark, C.is_formatted_number, items) == [True, True, False, False, True, False, True, True, True, False, False, False]
    assert apply(spark, C.is_plain_number, items) == [True, True, False, True, False, True, False, False, True, False, False, False]


def test_null_words(spark):
    items = ["N/A", " null ", "NULL()", "-", "x", "", "\\N"]
    assert apply(spark, C.fix_null_string, items) == ["", "", None, "", None, None, ""]
    assert apply(spark, C.is_null_like, items) == [True, False, True, True, False, False, True]


def test_genes(spark):
    assert apply(spark, C.restore_gene, ["2-Sep", " 1-Mar ", "2-sep", "13-Sep", "TP53", ""]) == ["SEPT2", "MARCH1", None, None, None, None]
    assert apply(spark, C.is_excel_date, ["2-Sep", "2-sep", "32-Jan", "2-Xyz", " 1-Mar", "100-Jan"]) == [True, True, True, False, True, False]


def reference_shape(v: str) -> str:
    out, i, v = "", 0, v.strip()
    months = [m.lower() for m in V.MONTHS]
    while i < len(v):
        j = i
        kind = "d" if v[i].isdigit() else "a" if v[i].isalpha() else "s" if v[i].isspace() else ""
        test = {"d": str.isdigit, "a": str.isalpha, "s": str.isspace}.get(kind)
        while test and j < len(v) and test(v[j]):
            j += 1
        j = max(j, i + 1)
        w = v[i:j]
        if kind == "d":
            out += "d" * min(len(w), 4)
        elif kind == "s":
            out += " "
        elif kind == "a":
            if len(w) == 3 and w.lower() in months:
                out += "Mmm"
            elif w.isupper():
                out += "A" * min(len(w), 4)
            else:
                out += "A" + "a" * min(len(w) - 1, 3) if w[0].isupper() else "a" * min(len(w), 4)
        else:
            out += w
        i = j
    return out


def test_shape(spark):
    items = ["2020-01-31", "2-Sep", "AB-12345", "Person 12", "x", "", "  padded  out ", "Ünïcode ÉTÉ", "a_b/c", "123456 7", "JAN"]
    assert apply(spark, C.shape, items) == [reference_shape(x) for x in items]
    assert apply(spark, lambda c: C.shape(c, keep_length=True), ["123456-ab"]) == ["dddddd-aa"]


@pytest.mark.parametrize("text,shapes", [("A b cde", {"ISOLATED_LETTER"}), ("ONE TWO THREE FOUR", {"ALLCAPS_RUN"}), ("ONE TWO THREE", set()), ("aaaa", {"REPEATED_CHAR"}), ("xy ..", {"REPEATED_PUNCT"}), ("maаmа", {"MIXED_SCRIPT"}), ("", set())])
def test_token_shapes(spark, text, shapes):
    assert set(apply(spark, T.token_shapes, [text])[0]) == shapes


def test_markers_and_classes(spark):
    got = set(apply(spark, T.markers, ["a >>> b (cid:12)  !!"])[0])
    assert got == {">>>", "(cid:", "U+E000", "!!"}
    rates = apply(spark, T.char_classes, ["ab1 ", ""])
    assert rates[0] == {"Ll": 500.0, "Nd": 250.0, "Zs": 250.0} and rates[1] == {}
