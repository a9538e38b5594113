"""Exact n-gram Jaccard join by adaptive multi-match prefixes, and the groups its links make.

Sets are the distinct hashed word shingles of a text. Texts with equal sets are one class; only one
representative of a class is compared. In the global order (estimated document frequency, then hash) the
l-prefix of a set s is its first |s| - ceil(t|s|) + l elements; two sets of Jaccard t or more share at
least l elements of their l-prefixes. Each document takes the l of least estimated cost, and a pair is
verified when it shares min(l, l') elements of the two prefixes (Wang, Li and Feng, 2012).

Families of near copies would make a candidate of each pair. Links already implied need not be found:
a few rounds first verify each document against one hub for each of its min-hash keys and merge what
links, then the join runs between representatives of different components only. No link between different
components is lost, so the components are those of the full join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import bitmap, forget, keep, with_ids
from .textkit import groups, in_bitmap, mix, shingles

WIDTH = 5
PERCENT = 75
SKETCH = 1 << 21
"""Counters of the document-frequency sketch (8 MB broadcast); an estimate is never below the true count."""
BLOCKS = 32
KEYS = 6
BINS = 64
"""Bytes of a document's one-permutation sketch, by which the hub rounds (only they) skip unlike pairs."""
UNLIKE = 28
"""Differing bytes from which a pair is skipped there; at a Jaccard of 0.75, 16 of 64 differ on average."""
LONGEST = 2
"""Largest l that a prefix is lengthened by. Any value gives the same links; longer prefixes join more postings."""
VERIFY_COST = 0.25
"""Cost of verifying a pair, for each shingle of the document, against 1 for reading a posting."""
BACK = 160
"""Documents before it in a key group that a document's sketch is compared with."""
CLOSEST = 4
"""Of those, how many are verified."""
SALT = 2048
"""Members of a hub compared in one group."""

_U = np.uint64


def _sets(texts: pa.Array):
    """(row, sorted distinct shingle hashes) of each text with words."""
    for lo, _, h, bounds in groups(texts):
        for i in range(len(bounds) - 1):
            if bounds[i + 1] > bounds[i]:
                yield lo + i, np.unique(shingles(h[bounds[i] : bounds[i + 1]], WIDTH))


_BIN_EDGES = np.arange(BINS, dtype=np.uint64) << _U(64 - BINS.bit_length() + 1)


def _sketch(s: np.ndarray) -> np.ndarray:
    """A byte of the smallest element of each of BINS equal ranges of hash values; 0 where a range is empty."""
    at = np.searchsorted(s, _BIN_EDGES)
    size = np.diff(np.append(at, len(s)))
    least = s[np.minimum(at, len(s) - 1)]
    return np.where(size > 0, (mix(least) % _U(127)).astype(np.int64) + 1, 0).astype(np.int8)


_SEEDS = mix(np.arange(1, KEYS + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407))


def _count_into(sketch: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        at, n = np.unique((np.concatenate(sets) & _U(SKETCH - 1)).astype(np.int32), return_counts=True)
        sketch[at] += n.astype(np.int32)


def _digest(batches):
    """A row for each document, and at the end the partition's document-frequency counts by blocks."""
    sketch = np.zeros(SKETCH, np.int32)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int8())), ("block", pa.int32()), ("counts", pa.binary())])
    for b in batches:
        n, d1, d2 = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        keys = np.zeros((b.num_rows, KEYS), np.int64)
        sketches = np.zeros((b.num_rows, BINS), np.int8)
        held, many = [], 0
        for row, s in _sets(b.column("text")):
            sketches[row] = _sketch(s)
            n[row] = len(s)
            d1[row] = s.sum(dtype=_U).view(np.int64)
            d2[row] = mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)
            for k in range(KEYS):
                keys[row, k] = mix(s ^ _SEEDS[k]).min().view(np.int64)
            held.append(s)
            many += len(s)
            if many >= 1 << 18:
                _count_into(sketch, held)
                held, many = [], 0
        _count_into(sketch, held)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * KEYS, KEYS).astype(np.int32)), pa.array(keys.ravel()))
        short = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * BINS, BINS).astype(np.int32)), pa.array(sketches.ravel()))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n), pa.array(d1), pa.array(d2), lists, short, pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], schema=schema
        )
    if sketch.any():
        import zstandard

        for k, part in enumerate(np.split(sketch, BLOCKS)):
            body = zstandard.ZstdCompressor(level=1).compress(part.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())
            yield pa.RecordBatch.from_pylist([{"doc_id": None, "n": -1, "block": k, "counts": body}], schema=schema)


def _add_blocks(key, table):
    import zstandard

    total = np.zeros(SKETCH // BLOCKS, np.int64)
    for body in table.column("counts"):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_py()), np.uint8)
        total += np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, np.iinfo(np.int32).max).astype("<i4").tobytes()], pa.binary())})


def prefix(s: np.ndarray, df: np.ndarray, percent: int = PERCENT, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """(l, the l-prefix) of a set with estimated document frequencies, for the l of least estimated cost.

    cost(l) = postings read + candidates * VERIFY_COST * |s|, where at most postings / l documents can
    share l elements of the prefix.
    """
    need = -(-percent * len(s) // 100)
    order = np.lexsort((s, df))
    most = min(longest, need)
    short = len(s) - need
    read = np.cumsum(np.maximum(df[order[: short + most]] - 1, 0).astype(np.float64))
    el = np.arange(1, most + 1)
    cost = read[short + el - 1] * (1 + VERIFY_COST * len(s) / el)
    best = int(cost.argmin()) + 1
    return best, s[order[: short + best]]


def _prefixes(shared):
    def run(batches):
        sketch = shared.value
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            rows, ls, parts = [], [], []
            for row, s in _sets(b.column("text")):
                best, p = prefix(s, sketch[(s & _U(SKETCH - 1)).astype(np.int64)])
                rows.append(row)
                ls.append(best)
                parts.append(p)
                if len(rows) >= 512 or row == b.num_rows - 1:
                    yield _prefix_batch(ids, rows, ls, parts)
                    rows, ls, parts = [], [], []
            if rows:
                yield _prefix_batch(ids, rows, ls, parts)

    return run


def _prefix_batch(ids, rows, ls, parts):
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts).view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(ids[rows].astype(np.int64)), pa.array(ls, pa.int32()), lists], ["doc_id", "l", "prefix"])


def _set_bytes(batches):
    """Sets for verification: the upper six bytes of each hash, sorted."""
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for at in range(0, b.num_rows, 256):
            piece = b.slice(at, 256)
            rows, bodies = [], []
            for row, s in _sets(piece.column("text")):
                rows.append(at + row)
                bodies.append(np.ascontiguousarray(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows].astype(np.int64)), pa.array(bodies, pa.binary())], ["doc_id", "body"])


def _load(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(">u8").astype(_U)


def _verify(percent: int):
    def run(batches):
        """Rows sorted by (hub, salt, member): the hub's own set comes first in each group."""
        group, hub = None, None
        for b in batches:
            out = []
            for g, salt, member, body in zip(*(b.column(c).to_pylist() for c in ("hub", "salt", "member", "body")), strict=True):
                if member is None:
                    group, hub = (g, salt), _load(body)
                elif group == (g, salt):
                    mine = _load(body)
                    small, large = (mine, hub) if len(mine) < len(hub) else (hub, mine)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    common = int((large[at] == small).sum())
                    if 100 * common >= percent * (len(mine) + len(hub) - common):
                        out.append((g, member))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def verify(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs (a, b; distinct) whose sets have Jaccard of percent or more. Each set goes once to each hub a."""
    sets = with_ids(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), then=_set_bytes, schema="doc_id bigint, body binary")
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select("a", F.ceil(F.col("m") / SALT).cast("int").alias("salts"))
    members = pairs.join(sizes, "a").select(
        F.col("b").alias("doc_id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("member")
    )
    hubs = sizes.select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("member"))
    rows = sets.join(members.unionByName(hubs), "doc_id").select("hub", "salt", "member", "body")
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first()).mapInArrow(_verify(percent), "a bigint, b bigint")


def _postings(bits_shared):
    def run(batches):
        bits = bits_shared.value
        for b in batches:
            lists = b.column("prefix")
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            owner = np.repeat(np.arange(b.num_rows), sizes)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = in_bitmap(bits, flat)
            own = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), pa.array(pos[hit].astype(np.int32)), *(b.column(c).take(own) for c in ("doc_id", "n", "l"))], ["token", "pos", "doc_id", "n", "l"])

    return run


def _meet(x: str, y: str, percent: int) -> tuple[Column, Column]:
    """(whether a posting shared by x and y counts for the pair, how many of those it must share).

    Texts of sizes n and n' that link share at least o = percent / (100 + percent) * (n + n') elements, so
    the first n - o + m of one and n' - o + m of the other share m of them, m being the smaller l of the two.
    Both lie within the l-prefixes, as o is at least percent / 100 of either size.
    """
    f = lambda side, c: F.col(f"{side}.{c}")
    o = F.ceil((f(x, "n") + f(y, "n")) * percent / (100 + percent))
    m = F.least(f(x, "l"), f(y, "l"))
    near = 100 * F.least(f(x, "n"), f(y, "n")) >= percent * F.greatest(f(x, "n"), f(y, "n"))
    return near & (f(x, "pos") < f(x, "n") - o + m) & (f(y, "pos") < f(y, "n") - o + m), m


def _central_pairs(keyed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the document of each key whose own keys are the most shared, and the key's others."""
    crowd = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = keyed.join(crowd, ["k", "v"])
    central = keep(shared.groupBy("doc_id").agg(F.sum("m").alias("crowd")), "crowds")
    rows = shared.join(central, "doc_id")
    hubs = rows.groupBy("k", "v").agg(F.max_by(F.struct("doc_id", "n"), F.struct("crowd", F.xxhash64("doc_id"))).alias("hub"))
    pairs = rows.join(hubs, ["k", "v"]).where(f"doc_id <> hub.doc_id and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)").select(
        F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    first, second = (sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, x: t + x)
    return pairs.join(first, "a").join(second, "b").where(differ <= UNLIKE).select("a", "b")


def _closest(percent: int):
    """For each row, of the BACK rows of its key before it, the CLOSEST by sketch that are of another component."""

    def run(batches):
        kept = None
        for b in batches:
            own = {c: b.column(c).to_numpy() for c in ("k", "v", "doc_id", "n", "comp")}
            own["sketch"] = b.column("sketch").flatten().to_numpy().reshape(-1, BINS)
            old = 0 if kept is None else len(kept["k"])
            all_ = own if kept is None else {c: np.concatenate([kept[c], own[c]]) for c in own}
            n = len(all_["k"])
            best = np.full((BACK, n - old), 127, np.int8)
            for j in range(1, min(BACK, n - 1) + 1):
                at = np.arange(max(old, j), n)
                x, y = all_["n"][at], all_["n"][at - j]
                fit = (all_["v"][at] == all_["v"][at - j]) & (all_["k"][at] == all_["k"][at - j]) & (all_["comp"][at] != all_["comp"][at - j])
                at = at[fit & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))]
                best[j - 1, at - old] = (all_["sketch"][at] != all_["sketch"][at - j]).sum(axis=1)
            order = np.argsort(best, axis=0, kind="stable")[:CLOSEST]
            a, c = [], []
            for o in order:
                hit = np.flatnonzero(best[o, np.arange(n - old)] <= UNLIKE)
                a.append(all_["doc_id"][old + hit])
                c.append(all_["doc_id"][old + hit - o[hit] - 1])
            x, y = np.concatenate(a), np.concatenate(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            kept = {k: v[-BACK:] for k, v in all_.items()}

    return run


def _neighbour_pairs(keyed: DataFrame, comp: DataFrame, sketches: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of different components that a key joins and whose sketches are close, a few for each document."""
    named = keyed.join(comp, "doc_id")
    mixed = named.groupBy("k", "v").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("k", "v")
    rows = named.join(mixed, ["k", "v"]).join(sketches, "doc_id").select("k", "v", "doc_id", "n", "comp", "sketch")
    order = F.xxhash64("doc_id", F.lit(turn))
    return rows.repartition("k", "v").sortWithinPartitions("k", "v", order).mapInArrow(_closest(percent), "a bigint, b bigint").distinct()


def _cross_pairs(postings: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of documents of different components that share enough of their prefixes."""
    cur = postings.join(comp, "doc_id")
    # pairs of components that meet in a token, then their members: no pair within a component is made. A posting
    # counts when pos < n - part * (n + n') + m; reach is the most that a component's members have for n'
    part = percent / (100 + percent)
    reach = F.col("n") * (1 - part) - F.col("pos") + F.col("l")
    per = cur.groupBy("token", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(reach).alias("reach"))
    met = per.alias("p").join(per.alias("q"), "token").where(
        f"p.comp < q.comp and 100 * q.hi >= {percent} * p.lo and 100 * p.hi >= {percent} * q.lo and q.reach >= {part} * p.lo and p.reach >= {part} * q.lo"
    ).select("token", F.col("p.comp").alias("comp"), F.col("q.comp").alias("other"), F.col("q.lo").alias("least"), F.col("q.reach").alias("reach"))
    smallest = F.greatest(F.col("least"), F.col("n") * percent / 100)
    useful = (reach >= part * smallest) & (F.col("reach") >= part * F.col("n"))
    left = met.join(cur, ["token", "comp"]).where(useful).drop("least", "reach").alias("x")
    counts, m = _meet("x", "y", percent)
    both = left.join(cur.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.other") == F.col("y.comp"))).where(counts)
    return both.groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first(m).alias("m")).where("c >= m").select("a", "b")


def _merge(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (doc_id, comp) after further edges between documents."""
    names = comp.select(F.col("doc_id").alias("a"), F.col("comp").alias("ca"))
    up = edges.join(names, "a").join(names.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    moved = components(up).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return keep(comp.join(moved, "comp", "left").select("doc_id", F.coalesce("to", "comp").alias("comp")), "components")


def join_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id bigint, text) -> doc_id, n_shingles, component_id, class_id, is_linked; one row per row.

    Words are runs outside 0x20 and 0x09-0x0D, A-Z lower-cased; a text with fewer than WIDTH words is one
    shingle; null and wordless texts have none and link with nothing. Documents link when 100 * shared >=
    percent * union. component_id is the smallest doc_id reachable by links; class_id the smallest doc_id
    with an equal set. Shingles are compared by 48 of 64 hash bits.
    Rows that repeat a doc_id should repeat its text; rows whose doc_id is null keep a null component.
    Empty tables give no rows; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    seen = keep(docs.mapInArrow(_digest, "doc_id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>, sketch array<tinyint>, block int, counts binary"), "digests")
    rows = seen.where("n >= 0")
    sketch = np.zeros(SKETCH, np.int32)
    blocks = seen.where("n < 0").select("block", "counts").groupBy("block").applyInArrow(_add_blocks, "block int, counts binary")
    for r in blocks.collect():  # BLOCKS rows of fixed size
        sketch[r["block"] * (SKETCH // BLOCKS) : (r["block"] + 1) * (SKETCH // BLOCKS)] = np.frombuffer(r["counts"], "<i4")
    shared = sc.broadcast(sketch)
    del sketch

    whole = rows.where("n > 0 and doc_id is not null")
    classes = keep(whole.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "classes")
    comp = classes.select(F.col("class_id").alias("doc_id"), F.col("class_id").alias("comp"))

    # rounds that merge families before the join: the most central document of each min-hash key, then neighbours
    sketches = classes.select(F.col("class_id").alias("doc_id"), "sketch")
    keyed = keep(
        classes.select(
            F.col("class_id").alias("doc_id"), "n",
            F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("keys")[k].alias("v")) for k in range(KEYS)])).alias("key"),
        ).select("doc_id", "n", "key.k", "key.v"), "keys",
    )
    comp = _merge(comp, keep(verify(docs, keep(_central_pairs(keyed, sketches, percent), "pairs"), percent), "links"))
    for turn in (0, 1):
        comp = _merge(comp, keep(verify(docs, keep(_neighbour_pairs(keyed, comp, sketches, percent, turn), "pairs"), percent), "links"))

    facts = classes.select(F.col("class_id").alias("doc_id"), "n").join(comp, "doc_id")
    prefixes = docs.where("doc_id is not null").mapInArrow(_prefixes(shared), "doc_id bigint, l int, prefix array<bigint>")
    lists = keep(prefixes.join(facts, "doc_id"), "prefixes")
    tokens = keep(
        lists.select("comp", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token"),
        "tokens",
    )
    bits = sc.broadcast(bitmap(tokens, "token", 24))
    postings = keep(
        lists.mapInArrow(_postings(bits), "token bigint, pos int, doc_id bigint, n bigint, l int").join(tokens, "token", "left_semi").distinct(), "postings"
    )
    forget(lists, tokens, keyed)
    pairs = keep(_cross_pairs(postings, comp, percent), "pairs")
    comp = _merge(comp, keep(verify(docs, pairs, percent), "links"))

    named = classes.select("d1", "d2", "n", "class_id").join(comp.withColumnRenamed("doc_id", "class_id"), "class_id")
    out = rows.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    none = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(none, F.col("doc_id")).otherwise(F.col("comp")).alias("component_id"),
        F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
    )


def op1_ngram_jaccard_join(spark, sf_dir):
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_near_duplicates(spark, docs, sf_dir):
    """Pipeline stage: of each group of linked documents the one with the smallest doc_id stays.

    Null, empty and wordless texts link with nothing and stay. Rows without doc_id go; of rows that repeat a doc_id one
    stays. An empty table gives no rows. Other columns go.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    groups_ = keep(join_components(docs), "groups")
    stay = groups_.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    left = docs.join(stay.select("doc_id"), "doc_id", "left_semi")
    return left.dropDuplicates(["doc_id"]) if stay.where("n > 1").limit(1).count() else left


ORACLE_OP1 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM docs),
cls AS (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY list_sort(s)) AS c FROM sh),
rep AS (SELECT doc_id, n, unnest(s) AS t FROM cls WHERE doc_id = c AND n > 0),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM rep a JOIN rep b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x),
comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT cls.doc_id, cls.n AS n_shingles, CASE WHEN cls.n = 0 THEN cls.doc_id ELSE coalesce(comp.c, cls.c) END AS component_id,
       CASE WHEN cls.n = 0 THEN cls.doc_id ELSE cls.c END AS class_id
FROM cls LEFT JOIN comp ON comp.x = cls.c
"""
