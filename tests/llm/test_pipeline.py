"""The pipeline on a small table: every stage's decisions, and its files against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import decontam, langid, mixing, near_dup
from recordloom.llm.store import keep
from recordloom.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        out[name] = keep(f(spark, docs, SF), name)
        docs = out[name]
    return out


def ids(df, repeats=False):
    got = [r["doc_id"] for r in df.select("doc_id").collect()]
    assert repeats or len(got) == len(set(got))
    return set(got)


def test_stages_keep_the_columns(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name in list(stages)[:-1]:
        assert stages[name].columns == want


def test_language_stage_keeps_documents_with_letters(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(ids(stages["language_id"])) >= 0.98 * docs.count()


def test_near_duplicates_one_of_each(stages):
    left = stages["near_duplicates"]
    assert near_dup.join_components(left).where("doc_id <> component_id").count() == 0
    assert ids(left) < ids(stages["language_id"])


def test_no_passage_is_left(spark, stages):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.contaminated(stages["decontamination"], bench).count() == 0


def test_mixing_drops_toxic_documents_and_meets_targets(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = keep(corpus_pipeline.STAGES[3][1](spark, docs, sf), "mixed")
    after = ids(mixed, repeats=True)
    clean, toxic = ([i for i, x in labels.items() if x == k] for k in (0, 1))
    assert sum(i in after for i in clean) >= 0.95 * len(clean)
    assert sum(i in after for i in toxic) <= 0.1 * len(toxic)
    member, targets = mixing._members(spark, docs, sf)
    have = mixed.groupBy("doc_id").count().join(member, "doc_id").selectExpr(*[f"sum(count * n_tokens * posterior[{d}]) t{d}" for d in range(4)]).first()
    for d, n in enumerate(mixing.NAMES):
        if targets[d]:
            assert abs(have[d] / targets[d] - 1) < 0.08, (n, have[d], targets[d])


def test_language_stage_rejects_what_no_language_explains(spark, tmp_path):
    rnd = random.Random(5)
    made = {"aa": ["tha", "ron", "eld", "ore"], "bb": ["quo", "zim", "urk", "pa"]}
    words = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(2)) for _ in range(30))
    rows = [(i, words(made[g]), g) for i, g in enumerate(list(made) * 60)]
    rows += [(1000 + i, words(["xyf", "kvj", "gwb", "hcc"]) + " tharon", None) for i in range(10)]
    rows += [(2000 + i, "".join(rnd.choice("bcdfghjklmnpqrstvwxz;#0123456789 ") for _ in range(200)), None) for i in range(10)]
    docs = spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert ids(langid.stage_language_id(spark, docs, str(tmp_path))) == set(range(120))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Null and repeated ids, null and empty texts, a column of a clashing name, and no rows at all."""
    f = dict(corpus_pipeline.STAGES)[name]
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "a text without a number that stays nowhere", "en", "s", 1), (-1, None, "en", "s", 1), (-2, "", None, None, None)], some.schema)
    docs = keep(some.unionByName(odd).unionByName(some.limit(3)).withColumns({"comp": F.lit(1), "n": F.lit("x"), "at": F.lit(0), "rate": F.lit(9.0)}), "odd")
    got = f(spark, docs, SF)
    rows = got.collect()
    assert all(r["doc_id"] is not None for r in rows) or name == "token_output"
    if name != "token_output":
        assert got.columns == some.columns
    if name in ("near_duplicates", "decontamination"):
        assert {-1, -2} <= {r["doc_id"] for r in rows}
    if name == "language_id":
        assert not {-1, -2} & {r["doc_id"] for r in rows}
    if name == "near_duplicates":
        assert len(rows) == len({r["doc_id"] for r in rows})
    assert f(spark, docs.limit(0), SF).count() == 0


def test_token_output(stages):
    kept = {r["doc_id"]: (r["text"], r["count"]) for r in stages["mixing"].groupBy("doc_id", "text").count().collect()}
    e, start = Encoder(public_tokenizers.path("byte_bpe_50k.json"), 9).tokenizer, 0
    got = sorted(stages["token_output"].collect(), key=lambda r: (r["doc_id"], r["start"]))
    at = 0
    for i in sorted(kept):
        text, n = kept[i]
        t = e.encode(text or "", add_special_tokens=False).ids + [0]
        for _ in range(n):
            assert (got[at]["doc_id"], got[at]["start"], got[at]["n_tokens"], got[at]["ids_crc32"]) == (i, start, len(t), zlib.crc32(np.array(t, "<u4").tobytes()))
            start += len(t)
            at += 1
    assert at == len(got)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries().keys()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert entry.oracle_sql().keys() <= names
    assert pq.read_schema(f"{SF}/documents.parquet").names[0] == "doc_id"
