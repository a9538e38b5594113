"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from recordloom.llm import decontam, exact_dedup, langid, line_dedup, lm, mixing, near_dup, planes, quality, token_counts
from recordloom.llm.store import keep, new_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n bigint, comp bigint, sha string, keys string, row bigint, token bigint, line string, held_out boolean"
LONG = "word " * 300_000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "a b c d e f g"), (2, None), (3, ""), (4, " \n\t \n"), (5, "x y"), (5, "x y"), (None, "a b c d e f g"), (6, LONG), (7, LONG.upper()), (8, "1 2 3"), (9, "ende\n\nende\nend"), (10, "\x00 é日本 \U0001f600"), (11, "A B C D E F G")]
    rows = [(i, t, "en" if t and len(t) < 100 else None, None, None, 1.0, 2, 3, "s", "k", 4, 5, "l", i == 8) for i, t in texts]
    return keep(spark.createDataFrame(rows, SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_near_duplicates(docs, none):
    got = near_dup.join_components(docs)
    assert got.count() == 13
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()}
    assert by[1] == (3, 1) and by[11] == (3, 1) and by[2] == (0, 2) and by[4] == (0, 4) and by[5] == (1, 5)
    assert by[6] == (1, 6) and by[7] == (1, 6) and by[None] == (3, None)
    assert near_dup.join_components(none).count() == 0


def test_token_files(spark, docs, none):
    out = new_path(spark, "f")
    planes.write_token_files(docs, out, BPE)
    got = planes.read_token_files(spark, out).orderBy("start").collect()
    assert len(got) == 13 and got[0]["doc_id"] is None and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert {r["doc_id"]: r["n_tokens"] for r in got}[2] == 1
    out = new_path(spark, "f")
    planes.write_token_files(none, out, BPE)
    assert planes.read_token_files(spark, out).count() == 0


def test_scores(docs, none):
    got = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    assert got[2]["n_tokens"] == 1 and got[3]["score"] == got[2]["score"] and got[6]["n_tokens"] == 300_001
    assert got[8]["held_out"] and got[8]["n_known"] == 1
    assert lm.score_texts(none).count() == 0
    alone = lm.score_texts(docs.withColumn("held_out", F.lit(True))).collect()
    assert len(alone) == 13 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in alone)


def test_quality(docs, none):
    got = quality.resample(docs, np.array([1, 5]), 0.5).collect()
    assert len(got) == 13 and not any(r["kept"] for r in got if r["doc_id"] is None)
    assert {r["doc_id"]: r["log_weight"] for r in got}[2] == 0
    assert quality.resample(none, np.zeros(0, np.int64)).count() == 0
    assert quality.resample(docs, np.zeros(0, np.int64)).count() == 13


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs.where("doc_id < 6"), docs.where("doc_id >= 6 or doc_id is null")).collect()
    by = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got}
    assert len(got) == 13
    assert by[1] == (11, 3, False) and by[11] == (11, 3, True) and by[None] == (11, 3, False)
    assert by[2] == (3, 2, False) and by[5] == (5, 2, True) and by[6] == (7, 2, False)
    nameless = docs.sparkSession.createDataFrame([(None, "Same"), (None, None)], "doc_id bigint, text string")
    got = exact_dedup.exact_dedup(nameless, nameless).collect()
    assert len(got) == 4 and {(r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(None, 2, False)}
    assert exact_dedup.exact_dedup(none, none).count() == 0
    assert exact_dedup.exact_dedup(none, docs).count() == 13 and exact_dedup.exact_dedup(docs, none).count() == 13


def test_token_counts(spark, docs, none):
    cache = new_path(spark, "c")
    got = token_counts.count_tokens(docs, cache, BPE)
    assert got.count() == 13 and rows(got.where("doc_id in (2, 3)"), "n_bytes", "n_tokens") == [(0, 0), (0, 0)]
    assert got.where("doc_id = 6").first()["over_limit"]
    assert token_counts.count_tokens(none, new_path(spark, "c"), BPE).count() == 0
    assert token_counts.count_tokens(none, cache, BPE).count() == 0


def test_fuzzy_lines(docs, none):
    got = line_dedup.line_groups(docs)
    assert got.count() == 11 + 3 + 4  # 4 has three lines, 9 has four, the rest one each
    by = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"], r["kept"]) for r in got.collect()}
    assert by[9, 2] == (9, 0, False) and by[9, 1] == (9, 1, True) and by[9, 3] == (9, 3, True) and by[2, 0] == (2, 0, True)
    assert by[1, 0] == (None, 0, False) and by[11, 0] == (None, 0, False)
    assert by[7, 0] == (6, 0, False)
    assert line_dedup.line_groups(none).count() == 0
    text = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs.where("doc_id in (2, 9)")).collect()}
    assert text == {2: "", 9: "ende\n\nend"}


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "x Y", 1), (2, None, 1), (3, "", 1), (4, "b c d e f", 1), (None, "x y", 1)], "item_id bigint, text string, n int")
    assert rows(decontam.contaminated(docs, items), "doc_id", "item_id", "at") == [(1, 4, 1), (11, 4, 1), (5, 1, 0)]
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_language(docs, none):
    model = langid.learn(docs)
    got = langid.predict(docs, model)
    assert {"lang_pred", "score", "comp"} <= set(got.columns)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert by[2] == ("und", 0) and by[3] == ("und", 0) and by[4] == ("und", 0) and by[8] == ("und", 0) and by[1][0] == "en" and by[10][0] == "en"
    assert langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(none)).collect()} == {"und"}


def test_mixing(docs, none):
    ids, domains = np.array([1, 5, 8]), np.array([0, 1, 2])
    member = keep(mixing.domain_posteriors(docs, ids, domains, ["a", "b", "c"]), "m")
    got = mixing.mix_rates(member, np.array([10.0, 10.0, 10.0])).collect()
    assert len(got) == 13 and all(r["rate"] >= 0 for r in got)
    empty = keep(mixing.domain_posteriors(none, ids, domains, ["a", "b", "c"]), "m")
    assert mixing.mix_rates(empty, np.array([1.0, 1.0, 1.0])).count() == 0
    assert keep(mixing.domain_posteriors(docs, ids[:0], domains[:0], ["a", "b"]), "m").count() == 13
