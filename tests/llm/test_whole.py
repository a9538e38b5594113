"""Whole results where an operator once did a part of its job."""

import math
import random

from recordloom.llm import line_dedup, lm, near_dup

from test_brute import plain_tree


def test_every_context_that_passes_is_a_state(spark):
    # far more states than words at hand, frequent words split over many buckets
    rnd = random.Random(5)
    follow = {f"w{k}": [f"w{rnd.randrange(300)}" for _ in range(2)] for k in range(300)}
    rows = []
    for i in range(150):
        x, out = f"w{rnd.randrange(300)}", []
        for _ in range(40):
            out += [x] + ([f"f{rnd.randrange(30)}"] if rnd.random() < 0.9 else [])
            x = rnd.choice(follow[x])
        rows.append((i, " ".join(out), i % 5 == 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean").repartition(3)
    got = {r["doc_id"]: r for r in lm.score_texts(docs, hot_words=31, size=100).collect()}
    seqs = {i: [*t.split(), "<end>"] for i, t, _ in rows}
    c, _, _, probability, states = plain_tree(seqs, {i: held for i, _, held in rows})
    assert len(states) > 150 and len(c) > 31
    for i, s in seqs.items():
        score = sum(math.log10(probability(tuple(s[max(0, k - lm.DEPTH) : k]), w)) for k, w in enumerate(s))
        assert math.isclose(got[i]["score"], score, rel_tol=1e-5, abs_tol=1e-4)


def test_all_lines_of_a_band_meet(spark):
    small, large = [(i, None, [7]) for i in range(10)], [(100 + i, None, [8]) for i in range(30)]
    classes = spark.createDataFrame(small + large, "uid bigint, sig_w array<bigint>, sig_a array<bigint>")
    two, many = line_dedup.shared_bands(classes)
    star = {(r["a"], r["b"]) for r in line_dedup.candidates(two, many).collect()}
    assert len([p for p in star if p[1] < 100]) == 9 and len([p for p in star if p[0] >= 100]) == 29
    alone = classes.selectExpr("uid", "uid comp")
    got = {(r["a"], r["b"]) for r in line_dedup.across(line_dedup._mixed(many, alone)).collect()}
    assert {p for p in got if p[1] < 100} == {(a, b) for b in range(10) for a in range(b)}
    hubs = min(line_dedup.HUBS, 30)
    assert len([p for p in got if p[0] >= 100]) == hubs * (30 - hubs) + hubs * (hubs - 1) // 2


def test_crowded_bands_lose_no_link(spark):
    # lines of one long passage and an own end, unlike each other; each has a near copy somewhere
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("aeionrstldp") for _ in range(rnd.randint(3, 8)))
    shared, lines = " ".join(word() for _ in range(14)), []
    for _ in range(50):
        end = [word() for _ in range(12)]
        lines += [f"{shared} {' '.join(end)}", f"{shared} {' '.join([*end[:-1], word()])}"]
    order = rnd.sample(range(len(lines)), len(lines))
    rows = [(i, lines[k]) for i, k in enumerate(order)]
    got = {r["doc_id"]: r["keep_doc_id"] for r in line_dedup.line_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    first = {}
    for i, k in enumerate(order):
        first.setdefault(k // 2, i)
    assert got == {i: first[k // 2] for i, k in enumerate(order)}


def test_verify_keeps_one_worker_a_core(spark):
    # screening and hashing of texts in two mapInArrow() in a row would run in two workers at once
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "v w x y z")], "doc_id bigint, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
    links = near_dup.verify(docs, pairs)
    assert [tuple(r) for r in links.collect()] == [(1, 2)]
    plan = links._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [k for k, line in enumerate(plan) if "MapInArrow" in line]
    assert len(at) == 2 and at[1] > at[0] + 1
