"""Normalisation of business names and addresses as Column functions.

The only Python on the path is latinise(), an Arrow UDF for transliteration and accents; everything after
it is built-in expressions. Values of tokens are arrays of words; *_text forms are joined by one space.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

_WAIT, _STOP, _BREAK = "", "", ""


def _reading_table() -> dict[int, str]:
    """str.translate table of all Indic characters.

    A consonant is followed by a mark for its inherent vowel, which a vowel sign or virama just after it
    takes away; silent signs vanish, and what has no reading leaves only a break.
    """
    table: dict[int, str] = {}
    for base in fixed.INDIC_BLOCKS:
        for place in range(128):
            if place in fixed.CONSONANTS:
                out = fixed.CONSONANTS[place] + _WAIT
            elif place in fixed.VOWEL_SIGNS:
                out = _STOP + fixed.VOWEL_SIGNS[place]
            elif place == fixed.VIRAMA:
                out = _STOP
            elif place in fixed.SILENT:
                out = ""
            elif place in fixed.VOWELS or place in fixed.SIGNS:
                out = _BREAK + (fixed.VOWELS.get(place) or fixed.SIGNS[place])
            elif base == fixed.MALAYALAM and place in fixed.MALAYALAM_CHILLU:
                out = _BREAK + fixed.MALAYALAM_CHILLU[place]
            elif 0 <= place - fixed.FIRST_DIGIT <= 9:
                out = _BREAK + str(place - fixed.FIRST_DIGIT)
            else:
                out = _BREAK
            table[base + place] = out
    return table


_READINGS = _reading_table()
_BEYOND = re.compile("[ऀ-\U0010ffff]")
_FINAL_A = re.compile(r"(?<=[bcdfghjklmnpqrstvwxyz])a\b")


def transliterate_text(text: str) -> str:
    """Latin reading of Indic text; text whose characters all lie below U+0900 is left alone.

    A word-final 'a' after a lower-case consonant goes, in Latin words of such a text too.
    """
    if not text or not _BEYOND.search(text):
        return text
    for pair, plain in fixed.MALAYALAM_CONJUNCTS:
        text = text.replace(pair, plain)
    out = text.translate(_READINGS).replace(_WAIT + _STOP, "").replace(_WAIT, "a")
    return _FINAL_A.sub("", out.replace(_STOP, "").replace(_BREAK, ""))


def strip_accents_text(text: str) -> str:
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _texts(s: pd.Series, f) -> pd.Series:
    return s.map(lambda x: f(x) if x else "")


@F.pandas_udf(T.StringType())
def transliterate(s: pd.Series) -> pd.Series:
    return _texts(s, transliterate_text)


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return _texts(s, strip_accents_text)


@F.pandas_udf(T.StringType())
def latinise(s: pd.Series) -> pd.Series:
    """Transliterated, then without accents; null gives the empty string."""
    return _texts(s, lambda x: x if x.isascii() else strip_accents_text(transliterate_text(x)))


# Letters of Western European Latin text; exact and JVM-side where a table holds no others.
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if len(strip_accents_text(chr(c))) == 1 and strip_accents_text(chr(c)).isascii())
_PLAIN = "".join(strip_accents_text(c) for c in _ACCENTED)


def strip_accents_latin(c: Column) -> Column:
    """strip_accents() for texts whose only non-ASCII letters are those of U+00C0 to U+017F."""
    return F.translate(c, _ACCENTED, _PLAIN)


def has_indic(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[ऀ-ൿ]").cast("int")


def clean(latin: Column) -> Column:
    """Lower-cased Latin text: '&' and '+' as words, apostrophes gone, other symbols as spaces."""
    c = F.lower(latin)
    c = F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(c, "[’'`]", ""), r"[^a-z0-9/\-\s.,#]", " ")


def base_clean(raw: Column, latin=latinise) -> Column:
    return clean(latin(raw))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def joined(c: Column) -> Column:
    return F.array_join(c, " ")


def _mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def expand(tokens: Column, values: dict[str, str]) -> Column:
    """Words replaced by their long forms; a long form of two words becomes two."""
    table = _mapping(values)
    return words(joined(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w))))


def phonetic(w: Column) -> Column:
    """Consonant skeleton of a word: rewrites, no vowels, no repeats; the first letter if nothing is left."""
    t = w
    for pattern, to in fixed.PHONETIC_REWRITES:
        t = F.regexp_replace(t, pattern, to)
    # squeezing keeps the first of a run, so vowels can go all at once
    bare = F.regexp_replace(F.regexp_replace(t, "[aeiouy]", ""), r"(.)\1+", "$1")
    return F.coalesce(F.nullif(bare, F.lit("")), F.substring(w, 1, 1))


def legal_forms(tokens: Column) -> Column:
    """Sorted distinct legal classes of words, by spelling or by skeleton."""
    table = _mapping(fixed.LEGAL_CLASSES)
    found = F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), F.try_element_at(table, phonetic(w))))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def domain_of(low: Column) -> Column:
    """Name of the first web domain in lower-cased Latin text, else a whole-text #handle or @handle."""
    site = F.regexp_extract(low, rf"(?U)(?:www\.)?([a-z0-9-]+)\.(?:{fixed.WEB_ENDINGS})\b", 1)
    handle = F.regexp_extract(low, r"^[#@]([a-z0-9_]+)$", 1)
    return F.replace(F.coalesce(F.nullif(site, F.lit("")), handle), F.lit("-"), F.lit(""))


def without_noise(low: Column) -> Column:
    for pattern, to in fixed.NAME_NOISE:
        low = F.regexp_replace(low, "(?iUd)" + pattern, to)
    return low


def name_tokens(low: Column) -> Column:
    """Words of a lower-cased Latin name: noise gone, runs of single letters glued, abbreviations expanded."""
    flat = joined(words(F.regexp_replace(clean(without_noise(low)), r"[.,/\-#]", " ")))
    glued = F.regexp_replace(flat, r"(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", "")
    return expand(words(glued), fixed.NAME_ABBREVIATIONS)


def core_tokens(tokens: Column) -> Column:
    legal, skeletons = _literals(fixed.LEGAL_WORDS), _literals(fixed.LEGAL_SKELETONS)
    kept = F.filter(tokens, lambda w: ~F.array_contains(legal, w) & ~w.rlike("^[0-9]+$") & ~F.array_contains(skeletons, phonetic(w)))
    return kept


def without_repeats(tokens: Column) -> Column:
    """Consecutive equal words collapse to one."""
    return F.filter(tokens, lambda w, i: (i == 0) | (w != F.get(tokens, i - 1)))


def with_name(df, raw: str, latin=latinise):
    """df with the name columns of column raw, each step once in the plan."""
    return (
        df.withColumn("_low", F.trim(F.lower(latin(F.coalesce(raw, F.lit(""))))))
        .withColumn("_toks", name_tokens(F.col("_low")))
        .withColumn("_kept", core_tokens(F.col("_toks")))
        .withColumn("_core", without_repeats(F.col("_kept")))
        .withColumns({
            "name_full": joined(F.col("_toks")),
            "name_core": joined(F.col("_core")),
            "name_sorted": joined(F.array_sort("_core")),
            "name_phon": joined(F.transform("_core", phonetic)),
            "name_concat": F.array_join("_core", ""),
            "domain": domain_of(F.col("_low")),
            "name_native": has_indic(F.col(raw)),
            "legal": joined(legal_forms(F.col("_toks"))),
        })
        .withColumn("is_domain", ((F.col("domain") != "") & (F.size("_core") == 0)).cast("int"))
        .drop("_low", "_toks", "_kept")
    )


def _address_words(part: Column) -> Column:
    return expand(words(F.regexp_replace(part, r"[.#/\-]", " ")), fixed.ADDRESS_ABBREVIATIONS)


def _plain_words(part: Column) -> Column:
    stops = _literals(fixed.ADDRESS_STOPS)
    return F.filter(_address_words(part), lambda w: w.rlike("^[a-z]+$") & (F.length(w) > 1) & ~F.array_contains(stops, w))


def with_address(df, raw: str, latin=latinise):
    """df with the address columns of column raw; street is the first comma part with a digit, else the first."""
    stops = _literals(fixed.ADDRESS_STOPS)
    parts = F.filter(F.transform(F.split("_clean", ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    numbered = F.array_position(F.transform("_parts", lambda p: p.rlike("[0-9]")), F.lit(True)).cast("int")
    return (
        df.withColumn("_clean", base_clean(F.coalesce(raw, F.lit("")), latin))
        .withColumn("_parts", parts)
        .withColumn("_toks", _address_words(F.replace(F.col("_clean"), F.lit(","), F.lit(" "))))
        .withColumn("_nums", F.filter(F.regexp_extract_all("_clean", F.lit(fixed.NUMBER), F.lit(0)), lambda n: F.length(n) <= 8))
        .withColumn("_si", F.greatest(numbered, F.lit(1)))
        .withColumns({
            "addr_full": joined(F.col("_toks")),
            "addr_words": joined(F.filter("_toks", lambda w: ~F.array_contains(stops, w) & ~w.rlike("^[0-9]"))),
            "addr_nums": joined(F.col("_nums")),
            "house_no": F.coalesce(F.get("_nums", F.lit(0)), F.lit("")),
            "postcode": F.coalesce(F.get(F.filter("_nums", lambda n: n.rlike("^[0-9]{5,6}$")), F.lit(0)), F.lit("")),
            "addr_empty": (F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s", "") == "").cast("int"),
            "addr_native": has_indic(F.col(raw)),
            "street": F.coalesce(joined(_plain_words(F.get("_parts", F.col("_si") - 1))), F.lit("")),
            "locality": joined(F.flatten(F.transform(F.filter("_parts", lambda p, i: i != F.col("_si") - 1), _plain_words))),
        })
        .drop("_clean", "_parts", "_toks", "_nums", "_si")
    )


KEPT = [
    "entity_id", "country", "src", "name_full", "name_core", "name_sorted", "name_phon", "name_concat", "domain", "is_domain",
    "name_native", "legal", "addr_full", "addr_words", "addr_nums", "house_no", "addr_empty", "addr_native", "street", "locality",
    "name_distinct", "house_dig", "num_tok", "first_tok", "n_len",
]


def enrich(records, latin=latinise):
    """records (entity_id, business_name, business_address, country) -> the 25 columns of KEPT.

    Nulls count as empty strings; an empty table gives an empty table of the same columns.
    """
    df = with_address(with_name(records, "business_name", latin), "business_address", latin)
    placed = F.array_union(words(F.col("street")), words(F.col("locality")))
    return df.withColumns({
        "src": F.substring("entity_id", 1, 2),
        "country": F.coalesce("country", F.lit("")),
        "name_distinct": joined(F.filter("_core", lambda w: ~F.array_contains(placed, w))),
        "house_dig": F.regexp_replace("house_no", "[^0-9]", ""),
        "num_tok": F.coalesce(F.get(words(F.col("addr_nums")), F.lit(0)), F.lit("")),
        "first_tok": F.coalesce(F.get("_core", F.lit(0)), F.lit("")),
        "n_len": F.size("_core"),
    }).select(*KEPT)
