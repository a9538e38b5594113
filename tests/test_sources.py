"""Sources, sinks, stores, streaming intake and the whole pipeline on small tables."""

import json
import os

import pytest

from recordloom.config import Config
from recordloom.functions.text import KEPT, enrich
from recordloom.sources import proxy, store, tsv
from recordloom.streaming.intake import intake

SF = "/root/testdata/sf0.001"


def test_tsv_keeps_quotes_spaces_and_empty_strings(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_bytes("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1_1\t\"A\\ b\" \t\tin\nS1_2\t x\xff\t1 r\t\n".encode("latin-1"))
    got = [tuple(r) for r in tsv.read_tsv(spark, str(path)).orderBy("entity_id").collect()]
    assert got == [("S1_1", '"A\\ b" ', "", "in"), ("S1_2", " x�", "1 r", "")]


def test_write_tsv(spark, tmp_path):
    df = spark.createDataFrame([("a", "x,y"), ("b", "")], "source1_entity_id string, matched_entity_ids string").coalesce(1)
    tsv.write_tsv(df, str(tmp_path / "o"))
    part = next(p for p in (tmp_path / "o").iterdir() if p.name.startswith("part"))
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\na\tx,y\nb\t\n"


def test_find_data_dir(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/train_source1.tsv").touch()
    assert tsv.find_data_dir(str(tmp_path)) == str(tmp_path / "a/b")
    with pytest.raises(FileNotFoundError):
        tsv.find_data_dir(str(tmp_path), "none")
    tsv.write_json({"a": 1}, str(tmp_path / "x/y.json"))
    assert json.load(open(tmp_path / "x/y.json")) == {"a": 1}


def test_audit_and_conservation(spark):
    df = spark.range(3)
    got = {r["name"]: (r["n_rows"], r["ok"]) for r in store.audit(spark, {"a": df, "b": df}, {"a": 3, "b": 4, "c": 1}).collect()}
    assert got == {"a": (3, True), "b": (3, False), "c": (None, False)}
    one = spark.createDataFrame([("S1", 1), ("S1", 2), ("S2", 3)], "src string, i int")
    assert store.conserved(one, one).count() == 0
    assert store.conserved(one, one.where("i > 1")).first().asDict() == {"src": "S1", "n_source": 2, "n_processed": 1}


def test_fingerprints():
    assert store.fingerprint({"a": 1, "b": 2}) == store.fingerprint({"b": 2, "a": 1})
    assert Config().block_fingerprint() != Config(max_df=10).block_fingerprint()
    assert Config().block_fingerprint() == Config(max_train_pairs=1).block_fingerprint()


def test_entity_store_prunes_by_country(spark, tmp_path):
    e = enrich(proxy.records(spark, SF))
    store.save_entities(e, str(tmp_path / "e"))
    got = store.load(spark, str(tmp_path / "e"))
    assert got.count() == e.count() and store.exists(spark, str(tmp_path / "e")) and not store.exists(spark, str(tmp_path / "f"))
    plan = got.where("country = 'en' and side = 'E1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(country" in plan


def test_streaming_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (tmp_path / "in/1.tsv").write_text(head + "S1_1\tAcme Ltd\t5 Main Rd, Pune\tin\n")
    run = lambda: intake(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in/2.tsv").write_text(head + "S2_1\tAcme Limited\t\tin\n")
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("entity_id").collect()
    assert [(r["entity_id"], r["name_core"], r["legal"]) for r in got] == [("S1_1", "acme", "ltd"), ("S2_1", "acme", "ltd")]
    assert set(got[0].asDict()) == set(KEPT)


def test_link_end_to_end(spark, tmp_path):
    from recordloom.plans.pipeline import link

    names = ["Northern Lights Bakery", "Acme Tools", "Blue River Foods", "Grand Hotel Paris", "Sunrise Textiles", "Silver Oak Traders", "Quick Print Shop", "Green Valley Farms"]
    rows = []
    for i in range(40):
        n = f"{names[i % 8]} {chr(97 + i)}{chr(98 + i % 20)}x"
        a = f"{100 + 7 * i} {names[(i * 3) % 8].split()[0]} Road, Town{i % 5}"
        rows += [(f"S1_{i}", n, a, "in"), (f"S2_{i}", n.upper() + " Ltd", a.replace("Road", "Rd"), "in")]
        if i % 2:
            rows.append((f"S3_{i}", n, "", "in"))
    records = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    truth = spark.createDataFrame([(f"S1_{i}", f"S{s}_{i}") for i in range(40) for s in (2, 3) if s == 2 or i % 2], "id1 string, id2 string")
    cfg = Config(ks={"name": 4, "both": 4}, key_k=5, rev_k=1, hop_k=1, max_train_pairs=10_000)
    out = link(records, truth, records, cfg, str(tmp_path), rounds=4, depth=3)
    assert out["decision"]["rule"] in ("threshold", "expected_f") and max(out["decision"]["f_threshold"], out["decision"]["f_expected"]) > 0.8
    got = {r["source1_entity_id"]: set(filter(None, r["matched_entity_ids"].split(","))) for r in out["matches"].collect()}
    assert len(got) == 40 and sum(f"S2_{i}" in got[f"S1_{i}"] for i in range(40)) >= 32
    assert os.path.exists(tmp_path / "scored") and out["chosen"] in ("first", "reranked") and out["rerank"]["f_val"] > 0
    lines = tsv.read_tsv(spark, str(tmp_path / f"matches-{out['fingerprint'][:12]}.tsv"), tsv.TRUTH).collect()
    assert [r["source1_entity_id"] for r in lines] == sorted(got) and {r["source1_entity_id"]: set(filter(None, r["matched_entity_ids"].split(","))) for r in lines} == got


def test_audit_finds_wrong_counts_and_missing_tables(spark):
    tables = {"a": spark.range(3), "b": spark.range(4)}
    got = {r["name"]: (r["n_rows"], r["ok"]) for r in store.audit(spark, tables, {"a": 3, "b": 5, "c": 1}).collect()}
    assert got == {"a": (3, True), "b": (4, False), "c": (None, False)}


def test_cut_off_utf8(spark, tmp_path):
    (tmp_path / "x.tsv").write_bytes("entity_id\tbusiness_name\nS1_1\tCaf\u00e9\n".encode()[:-2] + b"\n")
    assert tsv.read_tsv(spark, str(tmp_path / "x.tsv"), ["entity_id", "business_name"]).first()["business_name"] == "Caf\ufffd"
