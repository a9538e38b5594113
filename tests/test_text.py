"""Normalisation: literal strings and hand-derived values."""

import pytest

from pyspark.sql import functions as F

from recordloom.functions import text


@pytest.fixture(scope="module")
def name(spark):
    def run(*raws):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
        return [r.asDict() for r in text.with_name(df, "raw").orderBy("i").collect()]

    return run


@pytest.fixture(scope="module")
def address(spark):
    def run(*raws):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
        return [r.asDict() for r in text.with_address(df, "raw").orderBy("i").collect()]

    return run


@pytest.mark.parametrize(
    "raw,latin",
    [
        ("plain", "plain"), ("Été", "Été"), ("Maria’s Pizza", "Maria’s Pizz"), ("PIZZA’A", "PIZZA’A"),
        ("राम", "raam"), ("क्षत्रिय", "kshatriy"), ("लिमिटेड", "limited"), ("১২৩", "123"), ("ॐ", "om"), ("ന്റ", "nt"),
        ("അവൻ", "avan"), ("ड़", "d"), ("कa", "kaa"), ("", ""),
    ],
)
def test_transliterate(raw, latin):
    assert text.transliterate_text(raw) == latin


def test_accents_and_native(spark):
    df = spark.createDataFrame([("Frères ﬁn ß",), ("नमस्ते",), (None,)], "raw string")
    rows = df.select(text.strip_accents("raw").alias("a"), text.has_indic(F.col("raw")).alias("n")).collect()
    assert rows[0]["a"] == "Freres fin ß" and rows[2]["a"] == ""
    assert [r["n"] for r in rows] == [0, 1, 0]


def test_latin_accents_agree(spark):
    df = spark.createDataFrame([("ÀÉÎõüñç Žluťoučký straße",)], "raw string")
    r = df.select(text.strip_accents("raw").alias("a"), text.strip_accents_latin(F.col("raw")).alias("b")).first()
    assert r["a"] == r["b"] == "AEIounc Zlutoucky straße"


@pytest.mark.parametrize(
    "word,skeleton",
    [("corporation", "krprsn"), ("private", "prvt"), ("limited", "lmtd"), ("loop", "lp"), ("pivot", "pvt"), ("100", "10"), ("aeiou", "a"), ("philly", "fl"), ("school", "skl"), ("city", "st"), ("quick", "k")],
)
def test_phonetic(spark, word, skeleton):
    got = spark.createDataFrame([(word,)], "w string").select(text.phonetic(F.col("w"))).first()[0]
    assert got == skeleton


def test_names(name):
    a, b, c, d, e, f, g, h, i = name(
        "Clean  Highland LLC (ID: 52838)", "somesite.com", "#word", "WHITTLE and MITCHELL L.L.C.", "Europ & Frères S.A.",
        "X Y Vidya Vidya Corp | www.x.com", "Shop (north)", None, "www.abc.co.in",
    )
    assert (a["name_full"], a["name_core"], a["legal"], a["is_domain"]) == ("clean highland llc", "clean highland", "llc", 0)
    assert (b["domain"], b["name_core"], b["is_domain"]) == ("somesite", "", 1)
    assert (c["domain"], c["name_core"], c["is_domain"]) == ("word", "word", 0)
    assert (d["name_full"], d["name_core"]) == ("whittle and mitchell llc", "whittle mitchell")
    assert (e["name_full"], e["legal"]) == ("europ and freres sa", "sa")
    assert (f["name_full"], f["name_core"], f["name_sorted"], f["name_concat"]) == ("xy vidya vidya corporation", "xy vidya", "vidya xy", "xyvidya")
    assert g["name_full"] == "shop"
    assert (h["name_full"], h["name_core"], h["domain"], h["name_native"]) == ("", "", "", 0)
    assert (i["domain"], i["name_full"]) == ("abc", "in")


def test_legal_by_sound(name):
    assert [r["legal"] for r in name("Loop Coffee", "Acme Pvt Ltd", "Acme Public Company")] == ["lp", "ltd pvt", "co public"]


def test_addresses(address):
    a, b, c, d, e, f = address("309-313 RATTVIK CIR, BUFFALO, MN", "63 R. DE DIEPPE, LILLE, Hauts-de-France", "", None, "Flat 5, 14/2995 Main Rd, 560001", "2nd Road")
    assert (a["addr_full"], a["addr_words"], a["addr_nums"], a["house_no"]) == ("309 313 rattvik circle buffalo mn", "rattvik circle buffalo mn", "309 313", "309")
    assert (a["street"], a["locality"]) == ("rattvik circle", "buffalo mn")
    assert (b["addr_full"], b["addr_words"]) == ("63 rue de dieppe lille hauts de france", "rue dieppe lille hauts france")
    assert (c["addr_empty"], c["addr_full"], c["street"], c["locality"]) == (1, "", "", "")
    assert (d["addr_empty"], d["addr_nums"], d["postcode"]) == (1, "", "")
    assert (e["addr_full"], e["addr_nums"], e["postcode"], e["street"]) == ("flat 5 14 2995 main road 560001", "5 14/2995 560001", "560001", "")
    assert f["addr_nums"] == "2n"


def test_enrich(spark):
    df = spark.createDataFrame([("S1_1", "Lille Bakery Ltd", "63 R. DE DIEPPE, LILLE", "fr"), ("S2_2", None, None, None)], "entity_id string, business_name string, business_address string, country string")
    a, b = text.enrich(df).orderBy("entity_id").collect()
    assert a.asDict().keys() == set(text.KEPT)
    assert (a["src"], a["name_distinct"], a["house_dig"], a["num_tok"], a["first_tok"], a["n_len"]) == ("S1", "bakery", "63", "63", "lille", 2)
    assert (b["country"], b["name_core"], b["n_len"], b["first_tok"], b["addr_empty"]) == ("", "", 0, "", 1)
    assert text.enrich(df.limit(0)).count() == 0
