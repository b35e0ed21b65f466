import unicodedata

from pyspark.sql import functions as F

from lureline.functions import text as t
from lureline.operators import langid, normalize as nz


def one(spark, text, exact=False):
    return nz.normalize(spark.createDataFrame([(1, text)], "message_id long, text string"), exact=exact).first()


def test_obfuscation_is_undone_and_logged(spark):
    r = one(spark, "P4y hxxps://a[.]top p a y  n o w ze​ro Ｆｅｅ")
    assert r.normalized == "pay https://a.top pay now zero Fee"
    assert {"digit spellings decoded", "spaced letters joined", "defanged notation restored", "invisible characters removed"} <= set(r.transformations)


def test_two_lone_letters_are_left_alone(spark):
    assert one(spark, "x y is a b test").normalized == "x y is a b test"


def test_plain_text_changes_nothing(spark):
    r = one(spark, "See you on Monday.")
    assert (r.normalized, list(r.transformations), list(r.unicode_signals)) == ("See you on Monday.", [], [])


def test_exact_folding_agrees_with_unicode(spark):
    text = "ﬁne №5 Ａ½"
    assert one(spark, text, exact=True).normalized == unicodedata.normalize("NFKC", text)


def test_lookalikes_are_signalled(spark):
    r = one(spark, "Вank pаy")
    assert "look-alike characters" in r.unicode_signals and "pay" in r.normalized


def test_folding_keeps_the_length_of_latin_text(spark):
    df = spark.createDataFrame([("Đặt cọc, depósito, Überweisung",)], "x string")
    folded = df.select(t.fold_accents(F.col("x"))).first()[0]
    assert folded == "Dat coc, deposito, Uberweisung"


def test_languages(spark):
    rows = [("보증금을 내세요", "ko"), ("ادائیگی ہے", "ur"), ("votre compte avec les autres", "fr"), ("hello there", "en"), ("123", "unknown")]
    out = {r.text: r.language for r in langid.detect(spark.createDataFrame([(x,) for x, _ in rows], "text string")).collect()}
    assert out == dict(rows)
