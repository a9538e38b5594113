"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bitmap, keep
from .textkit import groups, in_bitmap, mix, shingles

WIDTH = 5
PERCENT = 75
RADIUS = 18
"""Fingerprints (64 bits) at most this far apart are candidates. A passage changed at one end to a similarity of just
0.75 lies 11 bits away on average with a deviation of 3 (the tests measure the share that is met)."""
LEAST_HITS = 0.6
"""A window is fingerprinted when this share of its shingles may occur in the benchmark. With weights between
1 and 2, a weighted similarity of 0.75 needs at least 0.6 of them, so no match is lost."""
SPAN = 1 << 14
"""Words whose bit sums are held at once."""

_U = np.uint64
_EDGES = np.linspace(0, 64, RADIUS + 2).astype(int)


def simhashes(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash, over the words, of the windows of size words at starts (ascending)."""
    out = np.zeros(len(starts), _U)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(int(np.searchsorted(starts, lo + max(SPAN - size, 1))), at + 1)
        part = words[lo : int(starts[to - 1]) + size]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=total[1:], dtype=np.int32)
        own = starts[at:to] - lo
        ones = total[own + size] - total[own]
        out[at:to] = np.packbits(2 * ones > size, axis=1, bitorder="little").view("<u8").ravel()
        at = to
    return out


def blocks(fingerprint: np.ndarray) -> list[np.ndarray]:
    """RADIUS + 1 blocks of bits: two fingerprints within RADIUS agree in at least one of them."""
    return [((fingerprint >> _U(a)) & _U((1 << int(z - a)) - 1)).astype(np.int64) for a, z in zip(_EDGES[:-1], _EDGES[1:], strict=True)]


def _sized(sh: np.ndarray, size: int) -> np.ndarray:
    """A shingle as one of items of a given size."""
    return mix(sh + _U(size * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)


def _items(batches):
    for b in batches:
        out = []
        for lo, _, h, bounds in groups(b.column("text")):
            for i in range(len(bounds) - 1):
                w = h[bounds[i] : bounds[i + 1]]
                if len(w):
                    fp = simhashes(w, np.array([0]), len(w))
                    out.append({"item_id": b.column("item_id")[lo + i].as_py(), "size": len(w), "fp": int(fp.view(np.int64)[0]), "shingles": shingles(w, WIDTH).view(np.int64).tolist(), "keys": _sized(shingles(w, WIDTH), len(w)).tolist(), "blocks": [int(x[0]) for x in blocks(fp)]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("fp", pa.int64()), ("shingles", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("blocks", pa.list_(pa.int64()))]))


_WINDOW = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("size", pa.int32()), ("fp", pa.int64()), ("shingles", pa.list_(pa.int64())), ("blocks", pa.list_(pa.int64()))])


def _full(own: np.ndarray, need: int, m: int, size: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of the windows of size words, m shingles, that hold need or more of the places own."""
    # windows from the first to the last of `need` hits that lie close enough
    low, high = own[need - 1 :] - m + 1, own[: len(own) - need + 1]
    close = low <= high
    if not close.any():
        return own[:0], own[:0]
    begin = np.unique(np.concatenate([np.arange(max(x, 0), y + 1) for x, y in zip(low[close].tolist(), high[close].tolist(), strict=True)]))
    begin = begin[begin + size <= bounds[-1]]
    text = np.searchsorted(bounds, begin, side="right") - 1
    whole = begin + size <= bounds[text + 1]
    return begin[whole], text[whole]


def _short(own: np.ndarray, need: int, width: int, size: int, bounds: np.ndarray):
    """(first word, text, words) of each text of fewer than size words that holds need or more of the places own."""
    lengths = np.diff(bounds)
    if not ((lengths < size) & (lengths - width + 1 >= need)).any():
        return
    text = np.searchsorted(bounds, own, side="right") - 1
    text = text[own + width <= bounds[text + 1]]
    many = np.bincount(text, minlength=len(lengths))
    for i in np.flatnonzero((many >= need) & (lengths < size)):
        yield bounds[i : i + 1], np.array([i]), int(lengths[i])


def _windows(shared, sizes: list[int]):
    widths = sorted({min(s, WIDTH) for s in sizes})

    def run(batches):
        any_size, one_size = shared.value
        for b in batches:
            ids = b.column("doc_id")
            for lo, _, h, bounds in groups(b.column("text")):
                hits = {}
                for width in widths:
                    if len(h) >= width:
                        sh = shingles(h, width)  # those across two texts are never used below
                        hits[width] = sh, np.flatnonzero(in_bitmap(any_size, sh.view(np.int64)))
                out = []
                for size in sizes:
                    width = min(size, WIDTH)
                    if width not in hits:
                        continue
                    sh, places = hits[width]
                    m = size - width + 1
                    need = max(1, int(np.ceil(LEAST_HITS * m)))
                    own = places[in_bitmap(one_size, _sized(sh[places], size))]
                    if len(own) < need:
                        continue
                    for begin, text, length in ((*_full(own, need, m, size, bounds), size), *_short(own, need, width, size, bounds)):
                        if not len(begin):
                            continue
                        fps = simhashes(h, begin, length)
                        parts = blocks(fps)
                        for k, (at, i) in enumerate(zip(begin.tolist(), text.tolist(), strict=True)):
                            out.append({"doc_id": ids[lo + i].as_py(), "at": at - int(bounds[i]), "size": size, "fp": int(fps[k].view(np.int64)), "shingles": sh[at : at + length - width + 1].view(np.int64).tolist(), "blocks": [int(p[k]) for p in parts]})
                    if len(out) > 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=_WINDOW)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_WINDOW)

    return run


def weighted_similarity(a: list[int], b: list[int], weight: dict[int, float]) -> float:
    """sum of min / sum of max of the shingles' counts times weights; a shingle that weight lacks weighs 2."""
    from collections import Counter

    ca, cb = Counter(a), Counter(b)
    low = high = 0.0
    for s in ca.keys() | cb.keys():
        w = weight.get(s, 2.0)
        low += w * min(ca[s], cb[s])
        high += w * max(ca[s], cb[s])
    return low / high if high else 0.0


def _verify(batches):
    for b in batches:
        sim = [
            weighted_similarity(x, y, dict(zip(z, w, strict=True)))
            for x, y, z, w in zip(*(b.column(c).to_pylist() for c in ("window", "item", "shingle", "weight")), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "item_id", "at", "size")), pa.array(sim, pa.float64())], ["doc_id", "item_id", "at", "size", "similarity"])


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id bigint, text), benchmark (item_id bigint, text) -> doc_id, item_id, at, size, similarity, n_windows.

    One row for each document and item with a window, as long in words as the item, whose weighted similarity
    of 5-word shingles with it is percent or more: the best window's first word (from 0) and similarity
    (ties: the first), the item's words as its size, and the number of windows. A text of fewer words than the
    item is one window. Words as in textkit; an item of fewer than 5 words is one shingle. The
    weight of a shingle is 1 + log((1 + N) / (1 + n)) / log(1 + N) for n of N items that have it, 2 for one
    that the item lacks.
    All windows of all texts are seen; windows with enough shingles that the benchmark may have are
    fingerprinted, joined with the items of their size on RADIUS + 1 blocks of bits, so that every
    fingerprint within RADIUS is met, and verified. Nulls and wordless texts match nothing, rows that repeat
    a doc_id count together, empty tables give no rows, other columns are ignored. Equal items match alike.
    """
    sc = docs.sparkSession.sparkContext
    items = keep(benchmark.select("item_id", "text").where("item_id is not null").mapInArrow(_items, "item_id bigint, size int, fp bigint, shingles array<bigint>, keys array<bigint>, blocks array<bigint>"), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # one row for each length
    n = items.count()
    flat = items.select("item_id", F.explode(F.array_distinct("shingles")).alias("shingle"))
    df = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    bits = sc.broadcast((bitmap(df, "shingle"), bitmap(items.select(F.explode("keys").alias("key")), "key")))
    weight = 1 + F.log((1.0 + n) / (1.0 + F.col("n"))) / F.log(F.lit(1.0 + max(n, 1)))
    weights = flat.join(df, "shingle").groupBy("item_id").agg(F.collect_list(F.struct("shingle", weight.alias("w"))).alias("ws"))
    windows = keep(
        docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(_windows(bits, sizes), "doc_id bigint, at bigint, size int, fp bigint, shingles array<bigint>, blocks array<bigint>"), "windows"
    )
    # one probe for each different fingerprint of a size, however many windows have it
    left = windows.select("size", "fp", F.posexplode("blocks").alias("k", "v")).distinct()
    right = items.select(F.col("size"), F.col("item_id"), F.col("fp").alias("item_fp"), F.posexplode("blocks").alias("k", "v"))
    near = left.join(right, ["size", "k", "v"]).where(f"bit_count(fp ^ item_fp) <= {RADIUS}").select("size", "fp", "item_id").distinct()
    found = (
        windows.select("doc_id", "at", "size", "fp", F.col("shingles").alias("window")).join(near, ["size", "fp"])
        .join(items.select("item_id", F.col("shingles").alias("item")), "item_id").join(weights, "item_id")
        .select("doc_id", "item_id", "at", "size", "window", "item", F.col("ws.shingle").alias("shingle"), F.col("ws.w").alias("weight"))
        .mapInArrow(_verify, "doc_id bigint, item_id bigint, at bigint, size int, similarity double")
        .where(F.col("similarity") * 100 >= percent - 1e-9)
    )
    best = F.max(F.struct("similarity", (-F.col("at")).alias("back"), "size"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.countDistinct("at").alias("n_windows")).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("at"), "best.size", F.round("best.similarity", 9).alias("similarity"), "n_windows"
    )


def op8_simhash_decontamination(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_decontamination(spark, docs, sf_dir):
    """Pipeline stage: documents that hold a passage of the benchmark go.

    Null, empty and wordless texts hold none and stay. Rows without doc_id go; of a repeated doc_id all rows go if one
    holds a passage. An empty table gives no rows, an empty benchmark takes none away. Other columns go.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    hit = keep(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti")
