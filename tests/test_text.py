"""Text functions against hand-worked values."""

from pyspark.sql import functions as F

from typeahead.functions import text as TX


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first()["x"]


def test_normalize_and_clean(spark):
    assert _one(spark, TX.normalize_text("t"), "  Red  DRESS\tx ") == "red dress x"
    assert _one(spark, TX.normalize_text("t"), None) == ""
    assert _one(spark, TX.clean_query("t"), " Red-Dress #5! ") == "red-dress 5"


def _grams(spark, value, n=3, strict=False):
    df = spark.createDataFrame([(value,)], "t string")
    return TX.add_char_ngrams(df, "t", "g", n, strict).first()["g"]


def test_char_ngrams_docstring_example(spark):
    assert _grams(spark, "dress") == ["dre", "res", "ess"]


def test_char_ngrams_counts_follow_length(spark):
    for w in ["dress", "kurti", "shoe", "saree"]:
        for n in (2, 3, 4):
            assert len(_grams(spark, w, n)) == max(len(w) - n + 1, 1)


def test_char_ngrams_short_and_empty(spark):
    assert _grams(spark, "ab") == ["ab"]
    assert _grams(spark, "") == []
    assert _grams(spark, "   ") == []
    assert _grams(spark, None) == []
    assert _grams(spark, " Ab ") == ["ab"]


def test_strict_trigrams(spark):
    assert _grams(spark, "ab", 3, strict=True) == []
    assert _grams(spark, " Ab", 3, strict=True) == [" Ab"]


def test_word_tokens(spark):
    got = _one(spark, TX.word_tokens("t"), "Red dress, size-42!")
    assert got == ["red", "dress", ",", "size", "-", "42", "!"]


def test_md5_int_matches_python(spark):
    import hashlib
    got = _one(spark, TX.md5_int("t"), "abc")
    assert got == int(hashlib.md5(b"abc").hexdigest()[:8], 16)
    assert spark.createDataFrame([("x",)], "t string").select(F.lit(1)).count() == 1
