"""Each operator against a plain computation on a small table."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from recordloom.llm import counts, decontam, exact_dedup, graph, langid, line_dedup, lm, mixing, near_dup, planes, quality, textkit, token_counts
from recordloom.llm.store import keep, new_path
from recordloom.llm.tokens import Encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return WORD.findall(low(s))


def sets(s, k=5):
    w = words(s)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def vocabulary(rnd, n=400):
    return ["".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def changed(rnd, text, share):
    w = text.split()
    for i in range(len(w)):
        if rnd.random() < share:
            w[i] = rnd.choice(["alpha", "beta", "gamma"])
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(11)
    v = vocabulary(rnd)
    base = [" ".join(rnd.choice(v) for _ in range(rnd.randint(3, 120))) for _ in range(40)]
    shared = " ".join(rnd.choice(v) for _ in range(60))
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base[:12]:
        for _ in range(rnd.randint(1, 6)):
            rows.append((len(rows), changed(rnd, t, rnd.choice([0.0, 0.005, 0.02, 0.04, 0.1]))))
    for _ in range(15):
        rows.append((len(rows), " ".join([*(rnd.choice(v) for _ in range(20)), shared, *(rnd.choice(v) for _ in range(20))])))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, base[0].upper()), (len(rows) + 3, "two words"), (len(rows) + 4, "two  WORDS")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return keep(spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3), "docs")


def brute_components(corpus, limit=75):
    s = {i: sets(t) for i, t in corpus}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= limit * (len(s[a]) + len(s[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def test_near_duplicates(docs, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.join_components(docs).collect()}
    want = brute_components(corpus)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_prefix_filter_is_complete():
    rnd = np.random.default_rng(0)
    for _ in range(300):
        pool = rnd.integers(1, 1 << 60, 80).astype(np.uint64)
        a = np.unique(rnd.choice(pool, rnd.integers(5, 70)))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.93], rnd.choice(pool, 3)]))
        both = len(np.intersect1d(a, b))
        df = lambda s: (s % np.uint64(50)).astype(np.int32) + 1
        if 100 * both >= 75 * (len(a) + len(b) - both):
            (la, pa), (lb, pb) = near_dup.prefix(a, df(a)), near_dup.prefix(b, df(b))
            shared = len(np.intersect1d(pa, pb))
            need = -(-(len(a) + len(b)) * 75 // 175) - max(len(a) - len(pa), len(b) - len(pb))
            assert shared >= min(la, lb) and shared >= need


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_word_hashes(corpus):
    import pyarrow as pa

    texts = [t for _, t in corpus] + ["ÀB é\x0bç Ａ日本 \U0001f600x"]
    seen = {}
    for lo, hi, h, bounds in textkit.groups(pa.array(texts)):
        for i in range(hi - lo):
            w = words(texts[lo + i])
            own = h[bounds[i] : bounds[i + 1]].tolist()
            assert len(w) == len(own)
            for x, y in zip(w, own):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_spark_hash(spark):
    x = [0, 1, -1, 2**62, -(2**63), 123456789]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in x], "x bigint").select(F.xxhash64("x")).collect()]
    assert textkit.spark_xxhash64(np.array(x)).view(np.int64).tolist() == got


def test_planes_round_trip():
    rnd = np.random.default_rng(1)
    for bits in (False, True):
        for ids in ([], [0], [0, 0, 0], rnd.integers(0, 50257, 5000), rnd.integers(0, 2**32, 333), [2**32 - 1]):
            x = np.array(ids, np.uint32)
            assert (planes.unpack_chunk(planes.pack_chunk(x, bits)) == x).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, docs, corpus, bits, monkeypatch):
    out = new_path(spark, "files")
    planes.write_token_files(docs, out, BPE, bits=bits)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in planes.read_token_files(spark, out).collect()}
    tokenizer, start, want = Encoder(BPE, 9).tokenizer, 0, {}
    for i, t in sorted(corpus):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want[i] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert got == want


def test_encoder_equals_the_library():
    rnd, e = random.Random(4), Encoder(BPE, 60)
    letters = list("abcXYZ 's't're  \n\t\r0123é'’µª²½…x\x1c\x85\xa0日本ß×÷") + ["<|endoftext|>", "  ", "'ll "]
    for _ in range(3000):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30)))
        assert np.frombuffer(e.encode([s])[0], "<u4").tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids, s
    long = " ".join(rnd.choice(["word", "other", "x\n", "  y"]) for _ in range(400_000))
    assert np.frombuffer(e.encode([long])[0], "<u4").tolist() == e.tokenizer.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(spark, docs, corpus, name):
    path, cache = public_tokenizers.path(name), new_path(spark, "cache")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, cache, path, 100).collect()}
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    for i, t in corpus:
        n = count(t or "")
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in corpus})
    more = docs.limit(5).unionByName(spark.createDataFrame([(900, "quite new")], "doc_id bigint, text string"))
    assert token_counts.count_tokens(more, cache, path).count() == 6
    assert spark.read.parquet(cache).count() == stored + 1


def test_exact_dedup(spark, docs, corpus):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")).collect()}
    groups = {}
    for i, t in corpus:
        groups.setdefault(low(t), []).append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
    assert len(got) == len(corpus) and len(groups) < len(corpus)


def test_stored_snapshot(docs, tmp_path):
    """A second batch reads the buckets and filters that the first one stored, and builds none."""
    path = f"file://{tmp_path}/snapshot"
    old = docs.where("doc_id % 3 = 0")
    first = exact_dedup.exact_dedup(old, docs.where("doc_id % 3 = 1"), path).where("incoming").collect()
    before = sorted(f.name for f in tmp_path.rglob("*.parquet"))
    again = exact_dedup.exact_dedup(old, docs.where("doc_id % 3 = 1"), path).where("incoming").collect()
    assert sorted(first) == sorted(again) and len(first) > 0
    assert before == sorted(f.name for f in tmp_path.rglob("*.parquet")) and len(before) > 1
    buckets, filters, shards = exact_dedup.stored_snapshot(exact_dedup.digests(old), path)
    assert shards == 1 == filters.count() and buckets.count() == exact_dedup.digests(old).select("sha").distinct().count()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 60_000])
def test_binary_fuse_filter(n):
    rnd = np.random.default_rng(n)
    keys = np.unique(rnd.integers(-(2**63), 2**63 - 1, n))
    f = exact_dedup.fuse_build(keys)
    assert exact_dedup.fuse_contains(keys, *f).all()
    other = rnd.integers(-(2**63), 2**63 - 1, 20_000)
    assert exact_dedup.fuse_contains(other, *f).mean() < 0.012


def plain_tree(seqs, held):
    """(counts of words, their sum, P0, P(w | context), times each state was seen) by the definition, on one machine."""
    c = Counter(w for i, s in seqs.items() if not held[i] for w in s)
    n, v = sum(c.values()), len(c)
    p0 = lambda w: (c[w] + 1) / (n + v + 1)
    nexts = {}
    for i, s in seqs.items():
        for k in range(len(s)):
            for d in range(1, min(k, lm.DEPTH) + 1):
                if not held[i]:
                    nexts.setdefault(tuple(s[k - d : k]), Counter())[s[k]] += 1
    states = {}

    def probability(context, w):
        if not context:
            return p0(w)
        lower = probability(context[1:], w)
        if context not in states:
            return lower
        return (nexts[context][w] + lm.BETA * lower) / (states[context] + lm.BETA)

    for d in range(1, lm.DEPTH + 1):
        for x in [x for x in nexts if len(x) == d]:
            m, parents = sum(nexts[x].values()), {w: probability(x[1:], w) for w in nexts[x]}
            gain = sum(k * math.log(((k - 1) / parents[w] + lm.BETA) / (m - 1 + lm.BETA)) for w, k in nexts[x].items())
            if m >= lm.LEAST and gain > lm.TEST:
                states[x] = m
    return c, n, p0, probability, states


@pytest.mark.parametrize("hot_words, size", [(lm.HOT, lm.BUCKET), (25, 200), (1, 40)])
def test_suffix_tree_scores(spark, docs, corpus, hot_words, size):
    """With all words at hand in a few buckets, and with few words at hand and frequent words split over buckets."""
    held = {i: i % 4 == 0 for i, _ in corpus}
    rows = spark.createDataFrame([(i, t, held[i]) for i, t in corpus], "doc_id bigint, text string, held_out boolean").repartition(3)
    got = {r["doc_id"]: r for r in lm.score_texts(rows, hot_words, size).collect()}
    seqs = {i: [*words(t), "<end>"] for i, t in corpus}
    c, n, p0, probability, states = plain_tree(seqs, held)
    assert {len(x) for x in states} == set(range(1, lm.DEPTH + 1))
    for i, s in seqs.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(s), sum(w in c for w in s), n, held[i])
        assert math.isclose(r["base_score"], sum(math.log10(p0(w)) for w in s), rel_tol=1e-9, abs_tol=1e-9)
        score = sum(math.log10(probability(tuple(s[max(0, k - lm.DEPTH) : k]), w)) for k, w in enumerate(s))
        assert math.isclose(r["score"], score, rel_tol=1e-5, abs_tol=1e-4)


def test_language_id(spark):
    rnd = random.Random(3)
    made = {"aa": ["tha", "ron", "eld"], "bb": ["quo", "zim", "urk"], "cc": ["tha", "zim", "opp"]}
    rows = [(i, " ".join("".join(rnd.choice(made[g]) for _ in range(3)) for _ in range(30)), g) for i, g in enumerate(list(made) * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(docs.where("doc_id % 4 <> 0"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    assert all(got[i][0] == g for i, _, g in rows) and all(0 <= s <= 1 for _, s in got.values())
    # every learned n-gram is reported for its language
    grams = np.arange(100, dtype=np.uint32) * 77
    m = langid.Model([("x", int(g)) for g in grams] + [("y", 5)])
    assert ((m.masks(grams)[0] >> np.uint64(0)) & np.uint64(1)).all()


def test_many_languages_take_several_slices():
    m = langid.Model([(f"l{k:03d}", k + 1) for k in range(130)])
    assert m.slots.shape[0] == 3
    masks = m.masks(np.arange(1, 131, dtype=np.uint32))
    assert all((masks[k // 64, k] >> np.uint64(k % 64)) & np.uint64(1) for k in range(130))


def test_decontamination(spark):
    rnd = random.Random(8)
    v = vocabulary(rnd, 2000)
    items = [(k, " ".join(rnd.choice(v) for _ in range(n))) for k, n in enumerate([3, 5, 12, 25, 40, 60])]
    fill = lambda n: " ".join(rnd.choice(v) for _ in range(n))
    rows = []
    for k, t in items * 4:
        e = rnd.choice([0, 0, 1, 2])
        w = t.split()
        for _ in range(e):
            w[rnd.randrange(len(w))] = "changed"
        rows.append((len(rows), f"{fill(rnd.randint(0, 50))} {' '.join(w).upper()}\n{fill(rnd.randint(0, 50))}"))
    rows += [(len(rows) + i, fill(80)) for i in range(10)]
    for k, t in items:  # texts shorter than the item: they lack words at an end
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate((t.split()[1:], t.split()[:-2], t.split()[: len(t.split()) // 2]))]
    got = {(r["doc_id"], r["item_id"]): (r["at"], r["similarity"]) for r in decontam.contaminated(
        spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    n = Counter(s for _, t in items for s in set(grams(t.split())))
    weight = {s: 1 + math.log(7 / (1 + c)) / math.log(7) for s, c in n.items()}
    want = {}
    for i, t in rows:
        w = words(t)
        for k, u in items:
            g = grams(u.split())
            own = {s: weight[s] for s in g}
            size = len(u.split())
            sims = [decontam.weighted_similarity(grams(w[a : a + size]), g, own) if w else 0 for a in range(max(1, len(w) - size + 1))]
            if sims and max(sims) >= 0.75:
                want[i, k] = sims.index(max(sims)), round(max(sims), 9)
    assert got == want and len(want) > 10


@pytest.mark.parametrize("size, changed", [(18, 2), (25, 3), (60, 8), (300, 42)])
def test_simhash_radius(size, changed):
    """Of passages whose end is changed to a similarity just over the threshold, the radius meets nearly all."""
    rnd = np.random.default_rng(size)
    far = 0
    for _ in range(2000):
        x = rnd.integers(0, 2**63, size).astype(np.uint64) << np.uint64(1) ^ rnd.integers(0, 2**63, size).astype(np.uint64)
        y = x.copy()
        y[-changed:] = rnd.integers(0, 2**63, changed).astype(np.uint64) << np.uint64(1) ^ rnd.integers(0, 2**63, changed).astype(np.uint64)
        assert size - 4 - changed >= 0.75 * (size - 4 + changed)
        fx, fy = (decontam.simhashes(z, np.array([0]), size)[0] for z in (x, y))
        far += int(fx ^ fy).bit_count() > decontam.RADIUS
    assert far <= 0.02 * 2000, far


def test_simhash_blocks():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        x = rnd.integers(0, 2**63, 1).astype(np.uint64)
        flips = rnd.choice(64, decontam.RADIUS, replace=False)
        y = x.copy()
        for f in flips:
            y ^= np.uint64(1) << np.uint64(f)
        assert any((a == b).all() for a, b in zip(decontam.blocks(x), decontam.blocks(y)))
    h = rnd.integers(0, 2**63, 500).astype(np.uint64)
    starts = np.array([0, 3, 250, 480])
    for s, f in zip(starts, decontam.simhashes(h, starts, 20)):
        bits = ((h[s : s + 20, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
        assert f == sum(1 << b for b in range(64) if 2 * bits[b] > 20)


def test_quality_sampling(spark):
    """log_weight from a plain count of the hashed n-grams, and the exact sample by weight and noise."""
    import pyarrow as pa

    rnd = random.Random(1)
    good, bad = vocabulary(rnd, 80), [f"junk{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choice(good if i % 4 else bad) for _ in range(rnd.randint(5, 60)))) for i in range(200)] + [(200, None), (None, "x y")]
    target = [i for i in range(200) if i % 4 and i % 2]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = quality.resample(docs, np.array(target), 0.75).collect()
    of = {}
    for lo, hi, h, bounds in textkit.groups(pa.array([t for _, t in rows]), (quality.BEGINNING,)):
        for k in range(hi - lo):
            w = h[bounds[k] : bounds[k + 1]]
            pairs = textkit.mix(w[:-1, 0] * np.uint64(3) + w[1:, 0])
            of[rows[lo + k][0]] = [int(x) % quality.SIZE for x in (*w[:, 0], *textkit.mix(w[:, 1] + np.uint64(7)), *pairs)]
    raw, aim = Counter(x for v in of.values() for x in v), Counter(x for i in target for x in of[i])
    n, m = sum(raw.values()), sum(aim.values())
    p_raw = lambda x: (raw[x] + 1) / (n + quality.SIZE)
    ratio = {x: math.log((aim[x] + quality.PRIOR * p_raw(x)) / (m + quality.PRIOR) / p_raw(x)) for x in raw}
    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.gumbel("doc_id").alias("g")).collect()}
    want = {i: sum(ratio[x] for x in v) for i, v in of.items()}
    for r in got:
        assert math.isclose(r["log_weight"], want[r["doc_id"]], rel_tol=1e-9, abs_tol=1e-9) and r["n_grams"] == len(of[r["doc_id"]])
    order = sorted((i for i in want if i is not None), key=lambda i: (-round(want[i] + noise[i], 6), i))
    assert {r["doc_id"] for r in got if r["kept"]} == set(order[: round(0.75 * len(rows))])
    assert abs(np.mean(list(noise.values())) - 0.577) < 0.3


@pytest.mark.parametrize("k", [0, 1, 7, 50, 99, 100, 200])
def test_top_k(spark, k):
    rnd = random.Random(k)
    rows = [(i, rnd.randint(-3, 3) * 10**9) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, s bigint")
    got = {r["doc_id"] for r in df.where(counts.top_k(df, k, "s", "doc_id")).collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_mixing_meets_its_targets(spark):
    rnd = np.random.default_rng(0)
    p = rnd.dirichlet([0.3, 0.3, 0.3], 300)
    t = rnd.integers(1, 400, 300)
    member = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(300)], "doc_id bigint, n_tokens bigint, posterior array<double>")
    targets = (t @ p) * np.array([0.5, 1.3, 0.9])
    got = mixing.mix_rates(member, targets).toPandas().sort_values("doc_id")
    reached = (got["rate"].to_numpy() * t) @ p
    assert (got["rate"] >= 0).all() and np.abs(reached / targets - 1).max() < 0.03
    # the same descent on one machine
    r, have, eta = np.ones(300), t @ p, 1 / (1 + mixing.RIDGE)
    for _ in range(2000):  # plain steps, without momentum
        r = np.maximum(0, r - eta * (p @ (((r * t) @ p - targets) / have) + mixing.RIDGE * (r - 1)))
    assert np.abs(r - got["rate"].to_numpy()).max() < 0.02
    assert len(mixing.fit_rates(member, targets)) < 100


def test_posteriors(spark):
    rnd = random.Random(6)
    own, shared = [[f"{'abcd'[d]}{i}" for i in range(15)] for d in range(4)], [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rnd.choice(own[i % 4] if k % 3 else shared) for k in range(30))) for i in range(800)]
    docs = spark.createDataFrame([*rows, (1000, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in mixing.domain_posteriors(docs, np.arange(600), np.arange(600) % 4, list("abcd")).collect()}
    assert all(np.argmax(got[i]["posterior"]) == i % 4 for i, _ in rows)
    assert max(got[1000]["posterior"]) < 0.5 and got[1000]["n_tokens"] == 0


def test_fuzzy_lines(spark):
    rnd = random.Random(9)
    v = vocabulary(rnd, 300)
    pool = [" ".join(rnd.choice(v) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    rows = []
    for i in range(40):
        own = [rnd.choice(pool) for _ in range(4)]
        own = [changed(rnd, x, 0.03).upper() if rnd.random() < 0.4 else f" {x} " for x in own]
        rows.append((i, "\n".join([*own, "", "ab"])))
    got = {(r["doc_id"], r["line_no"]): ((r["keep_doc_id"], r["keep_line_no"]), r["kept"]) for r in line_dedup.line_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    first = {}
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if x.strip(" "):
                first.setdefault(x.strip(" ").lower(), (i, k))
    grams = {x: {x[j : j + 9] for j in range(len(x) - 8)} or {x} for x in first}
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lines = list(first)
    for a in range(len(lines)):
        for b in range(a):
            x, y = grams[lines[a]], grams[lines[b]]
            if 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(lines[a]), find(lines[b])), key=first.get)
                root[q] = p
    wrong = total = 0
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            key = x.strip(" ").lower()
            want = first[find(key)] if key else (i, k)
            total += 1
            wrong += got[i, k] != (want, want == (i, k))
    assert len(got) == total and wrong <= 0.02 * total


def lines_of_three_kinds(seed, base, copies):
    """kind -> lines: 18 words with one changed; half of each line a common phrase; six words with an e, one of them changed."""
    rnd = random.Random(seed)
    v = ["".join(rnd.choice("bcdfghjklmnprstvw") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(3000)]
    with_e, without = [w for w in v if "e" in w], [w for w in v if "e" not in w]
    phrase = [rnd.choice(v) for _ in range(9)]
    out = {"plain": [], "half": [], "few": []}
    for _ in range(base):
        few = [rnd.choice(without) for _ in range(14)]
        for k in rnd.sample(range(14), 6):
            few[k] = rnd.choice(with_e)
        for kind, line in (("plain", [rnd.choice(v) for _ in range(18)]), ("half", [rnd.choice(v) for _ in range(9)] + phrase), ("few", few)):
            out[kind].append(" ".join(line))
            for _ in range(copies):
                m = list(line)
                if kind == "few":
                    m[rnd.choice([i for i, w in enumerate(m) if "e" in w])] = rnd.choice(without)
                else:
                    m[rnd.randrange(9 if kind == "half" else 18)] = rnd.choice(v)
                out[kind].append(" ".join(m))
    return {k: list(dict.fromkeys(x)) for k, x in out.items()}


@pytest.mark.parametrize("base, copies", [(60, 2), (400, 3)])
def test_fuzzy_lines_recall(spark, base, copies):
    """Of the lines that an exact comparison merges, by kind; nothing else may be merged."""
    made = lines_of_three_kinds(base, base, copies)
    lines = [x for k in made for x in made[k]]
    grams = [{x[j : j + 9] for j in range(len(x) - 8)} or {x} for x in lines]
    posted, root = {}, list(range(len(lines)))
    for i, g in enumerate(grams):
        for h in g:
            posted.setdefault(h, []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, g in enumerate(grams):
        for j, n in Counter(j for h in g for j in posted[h] if j < i).items():
            if 100 * n >= 75 * (len(g) + len(grams[j]) - n):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["keep_doc_id"] for r in line_dedup.line_groups(docs).collect()}
    assert all(find(got[i]) == find(i) for i in range(len(lines)))
    at = 0
    for kind, own in made.items():
        ids = range(at, at + len(own))
        at += len(own)
        want, have = (len(ids) - len({f(i) for i in ids}) for f in (find, got.get))
        assert want > 0 and have >= 0.95 * want, (kind, want, have)


def test_fuzzy_lines_against_exact_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = {(r[0], r[1]): r[2:] for r in c.execute(f"SELECT doc_id, line_no, keep_doc_id, keep_line_no, kept FROM ({line_dedup.EXACT_SQL})").fetchall()}
    got = {(r[0], r[1]): tuple(r[2:]) for r in line_dedup.op7_fuzzy_lines(spark, "/root/testdata/sf0.01").select("doc_id", "line_no", "keep_doc_id", "keep_line_no", "kept").collect()}
    assert got.keys() == want.keys()
    gone, missed = sum(not r[2] for r in want.values()), sum(got[k] != want[k] for k in want)
    assert gone > 1000 and missed <= 0.01 * gone
