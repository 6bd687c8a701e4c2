"""Literal cases of the scalar functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from procaudit.functions import text as T
from procaudit.functions import values as V


def values(spark, inputs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


CASES = [
    (V.normalize_code, {"CPT-43239 ": "43239", "abc": "", None: ""}),
    (V.normalize_percent, {"50%": "50", "0.5": "50", "0,5": "50", "1": "100", "0": "0", "75,5": "75.5", "33.333": "33.33", "": "100", " ": "100", None: "100", "aprox 50": "50", "x": "100", "1,234.5": "12345", "100": "100"}),
    (V.normalize_time, {"2,0": "2", "1.5": "1.5", "0.004": "0", "": "0", None: "0", "3 h": "3", "x": "0"}),
    (V.normalize_number, {"10.50": "10.5", "2,0": "2", "1,234.5": "12345", "1e2": "100", "x": "", "": "", None: "", "5d": "5", "nan": ""}),
    (V.normalize_scalar, {"50": "50", "75,5": "75.5", "43239(50)": "", "50%": "", "-5": ""}),
    (T.squeeze_text, {" a \t b\n": "a b", None: ""}),
    (T.clean_text, {"<b>Colonoscop&iacute;a</b>  N&ordm;1": "colonoscopia n 1", None: "", "ÁÉ ñ": "ae n"}),
]


@pytest.mark.parametrize("f, cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_literals(spark, f, cases):
    assert values(spark, list(cases), f) == list(cases.values())


def test_split_codes(spark):
    assert values(spark, ["43239, 45378+43239,", None, ""], V.split_codes) == [["43239", "45378"], [], []]


def test_fees(spark):
    lenient = lambda codes: lambda c: V.parse_fees_lenient(c, F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>"))
    assert dict(values(spark, ["43239(50),45378()"], lenient(["43239", "45378"]))[0]) == {"43239": "50", "45378": "100"}
    assert dict(values(spark, ["9(50%)"], lenient(["1"]))[0]) == {"9": "50%", "1": "100"}
    assert dict(values(spark, ["a(1),a(2)"], lenient([]))[0]) == {"a": "2"}
    found = values(spark, ["43239 ( 50,0 ), 45378(100)", "43198(50%)", "1(,)"], V.parse_fees_numeric)
    assert [dict(x) for x in found] == [{"43239": "50", "45378": "100"}, {}, {}]


def test_words_and_grams(spark):
    assert sorted(values(spark, ["via oral con biopsia de colon colon"], T.content_words)[0]) == ["biopsia", "colon", "colon"]
    assert values(spark, ["ab", "a", None], T.char_ngrams) == [[" ab", "ab ", " ab "], [" a "], []]
    assert values(spark, ["a", "a\U0001d7d8b\t c"], lambda t: T.char_ngrams(t, 4, 4)) == [[" a "], [" a0b", "a0b ", " c "]]


def test_grams_are_those_of_every_padded_word(spark):
    texts = ["  uno dos  tres ", "x", "\u00c1rbol caf\u00e9\n\ty z", "\U0001f600\U0001f600 a\U0001f600b", "a\u00a0b", ""]
    expected = []
    for t in texts:
        t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        words = [f" {w} " for w in t.split()]
        expected.append(sorted(w[i : i + n] for w in words for n in (3, 4, 5) for i in range(len(w) - n + 1)))
    assert [sorted(g) for g in values(spark, texts, T.char_ngrams)] == expected


def test_time_summary_and_class(spark):
    rows = spark.createDataFrame([(0, ["2", "1.5", "x"]), (1, [])], "i int, t array<string>").select(V.time_summary(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["2", ""]
    rows = spark.createDataFrame([(n,) for n in (1000, 999, 100, 99, 10, 9)], "n int").select(V.freq_class(F.col("n")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["ALTA_FRECUENCIA", "MEDIA_FRECUENCIA", "MEDIA_FRECUENCIA", "BAJA_FRECUENCIA", "BAJA_FRECUENCIA", "RARA_REVISAR"]
