"""Fuzzy line deduplication by MinHash, with DataFrame and SQL functions only.

A line's signature is the DEPTH smallest hashes of its WIDTH-character shingles: of those that begin a word (or
stand at any other character than a-z) where there are FEW or more, of all where there are fewer than twice FEW;
so a line in between has both signatures, and similar lines always have one of a kind. Bands are runs of BAND
neighbours of the sorted signature: two lines of similarity J share a run with probability J ** BAND at each
place, so lines above the threshold miss each other at every place only rarely. Pairs that meet in a band and
whose signatures agree in SOME or more of DEPTH places are compared by the exact Jaccard similarity of all
their shingles, links are joined by distributed union-find, and one line of each component stays.

In a band of many lines each is first compared with the band's most central one. After the union-find, lines of
different components of a band meet: all of them in bands of at most CROWD lines; in larger ones each component and the
HUBS largest, and then all that remain different by an exact prefix join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .store import bitmap, forget, keep

WIDTH = 9
PERCENT = 75
DEPTH = 12
BAND = 3
FEW = 12
SOME = 5
CROWD = 16
MATCHES = 4
"""Shingles that lines of a crowded band must share in their prefixes, which are so much longer."""
HUBS = 8
"""Components of a larger band that its others are compared with before the join."""
BITS = 23


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r\v\f")))


def shingles(line: Column) -> Column:
    """All WIDTH-character shingles of a normalised line; a shorter line is one."""
    return F.when(F.length(line) < WIDTH, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(f"(?=(.{{{WIDTH}}}))"), F.lit(1)))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line (normalised) of every line."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    return rows.select("doc_id", "line_no", normal(F.col("raw")).alias("line"))


def digest(line: Column) -> Column:
    """The identity of a line; none for a blank one."""
    return F.when(line != "", F.unhex(F.md5(line)))


def hashed(line: Column) -> Column:
    """The different hashes of a line's shingles."""
    return F.array_distinct(F.transform(shingles(line), lambda x: F.xxhash64(x)))


def bands(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, id, sig_w, sig_a: identity and signatures of every line; no identity for a blank one."""
    # a run of letters and the character after it are passed over at once, so the scan stops at beginnings only
    begins = F.regexp_extract_all("line", F.lit(f"(?=(.{{{WIDTH}}}))(?:[a-z]++[^a-z]?|.)"), F.lit(1))
    some = lines.select("doc_id", "line_no", "line", digest(F.col("line")).alias("id"), begins.alias("begins"))
    # sort_array sorts longs in place, array_sort by a comparator that costs twice the rest
    least = lambda x: F.slice(F.sort_array(F.array_distinct(F.transform(x, lambda y: F.xxhash64(y)))), 1, DEPTH)
    return some.select(
        "doc_id", "line_no", "id", F.when(F.size("begins") >= FEW, least(F.col("begins"))).alias("sig_w"),
        F.when(F.size("begins") < 2 * FEW, least(shingles(F.col("line")))).alias("sig_a"),
    )


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each different line of bands(): uid (a number of the stored table), id, doc_id and line_no of its first place, signatures."""
    once = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), *[F.first(c).alias(c) for c in ("sig_w", "sig_a")])
    return once.select("id", "first.doc_id", "first.line_no", "sig_w", "sig_a", F.monotonically_increasing_id().alias("uid"))


def _keys(sig: str) -> Column:
    """Band keys of a signature, none where it is null."""
    runs = F.array(*[F.xxhash64(F.lit(sig), *[F.get(sig, F.lit(i + k)) for k in range(BAND)]) for i in range(DEPTH - BAND + 1)])
    there = F.slice(runs, F.lit(1), F.greatest(F.size(sig) - (BAND - 1), F.lit(1)))
    return F.when(F.col(sig).isNotNull(), there).otherwise(F.array().cast("array<bigint>"))


def _posted(classes: DataFrame) -> DataFrame:
    return classes.select("uid", F.explode(F.array_distinct(F.concat(_keys("sig_w"), _keys("sig_a")))).alias("key"))


def _pair(a, b) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def shared_bands(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n, lo, hi, x of each band of two or three lines: least, greatest and exclusive or of their uids;
    uid, key, n of the lines of larger bands).

    Most bands hold one line and end in the aggregation; only lines of larger bands are looked up again.
    """
    band = _posted(classes).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.bit_xor("uid").alias("x"))
    shared = keep(band.where("n > 1"), "line-bands")
    large = shared.where("n > 3").select("key", "n")
    return shared.where("n <= 3"), keep(_among(_posted(classes), large, F.col("key")).join(large, "key").select("uid", "key", "n"), "line-crowds")


def candidates(small: DataFrame, large: DataFrame) -> DataFrame:
    """a, b: all pairs of bands of two or three lines; in larger ones each line and the one whose bands are the largest."""
    lo, hi = F.col("lo"), F.col("hi")
    mid = F.col("x").bitwiseXOR(lo).bitwiseXOR(hi)
    two_or_three = small.select(F.explode(F.when(F.col("n") == 2, F.array(_pair(lo, hi))).otherwise(F.array(_pair(lo, mid), _pair(lo, hi), _pair(mid, hi)))).alias("p"))
    central = large.groupBy("uid").agg(F.sum("n").alias("c"))
    hubs = large.join(central, "uid").groupBy("key").agg(F.max_by("uid", F.struct("c", "uid")).alias("hub"))
    star = large.join(hubs, "key").where("uid <> hub").select(_pair(F.col("uid"), F.col("hub")).alias("p"))
    return two_or_three.union(star).select("p.a", "p.b").distinct()


def _mixed(large: DataFrame, comp: DataFrame) -> DataFrame:
    """uid, key, n, comp of the lines of bands that hold different components; comp (uid, comp)."""
    placed = large.join(comp, "uid", "left").select("uid", "key", "n", F.coalesce("comp", "uid").alias("comp"))
    keys = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return placed.join(keys, "key")


def across(mixed: DataFrame) -> DataFrame:
    """a, b: pairs of different components of a band: all of at most CROWD lines; of more, the most central line of
    each component with those of the HUBS components that have the most lines there."""
    few = mixed.where(f"n <= {CROWD}").select("key", "uid", "comp")
    every = few.join(few.select("key", F.col("uid").alias("other"), F.col("comp").alias("other_comp")), "key").where("comp < other_comp").select(_pair(F.col("uid"), F.col("other")).alias("p"))
    many = mixed.where(f"n > {CROWD}")
    central = many.groupBy("uid").agg(F.sum("n").alias("c"))
    rows = many.join(central, "uid").groupBy("key", "comp").agg(F.max_by("uid", F.struct("c", "uid")).alias("uid"), F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("key").orderBy(F.desc("m"), "comp")
    hubs = rows.withColumn("r", F.row_number().over(order)).where(f"r <= {HUBS}").select("key", F.col("uid").alias("hub"))
    star = rows.join(hubs, "key").where("uid <> hub").select(_pair(F.col("uid"), F.col("hub")).alias("p"))
    return every.union(star).select("p.a", "p.b").distinct()


def crowded(lines: DataFrame, classes: DataFrame, mixed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: the pairs of lines of bands of more than CROWD lines that can be links and lie in different components.

    Similar lines share MATCHES of the first shingles in any common order (multi-match prefix filter), and those leave
    enough after them in both (position filter), so no link is lost; the order is by frequency among these lines.
    """
    few = keep(mixed.where(f"n > {CROWD}").select("uid", "comp").distinct(), "line-crowds")
    texts = _texts(lines, classes, few.select("uid"))
    sets = keep(texts.select("uid", hashed(F.col("line")).alias("sh")).join(few, "uid"), "line-sets")
    forget(texts)
    flat = sets.select("uid", "comp", F.size("sh").alias("n"), F.explode("sh").alias("h"))
    often = flat.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shingles of one line only come first in the order and meet nothing
    ranked = flat.join(often, "h").select("uid", "comp", "n", "h", "df")
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("uid"))
    ranked = ranked.select("uid", "comp", "n", "h", (alone + F.row_number().over(Window.partitionBy("uid").orderBy("df", "h")) - 1).alias("r"))
    prefix = keep(ranked.where(f"r <= n - ({percent} * n + 99) div 100 + {MATCHES - 1}"), "line-prefixes")
    other = prefix.select("h", *[F.col(c).alias(f"other_{c}") for c in ("uid", "comp", "n", "r")])
    met = prefix.join(other, "h").where(
        f"uid < other_uid and comp <> other_comp and 100 * least(n, other_n) >= {percent} * greatest(n, other_n)"
        f" and {100 + percent} * (least(n - r, other_n - other_r) + {MATCHES - 1}) >= {percent} * (n + other_n)"
    )
    need = F.ceil((F.col("n") + F.col("other_n")) * percent / (100 + percent))
    met = met.groupBy(F.col("uid").alias("a"), F.col("other_uid").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first(F.least(need, F.lit(MATCHES))).alias("m")).where("c >= m").select("a", "b")
    pairs = keep(met, "line-pairs")
    forget(few, sets, prefix)
    return pairs


def _among(rows: DataFrame, some: DataFrame, key: Column) -> DataFrame:
    """Rows whose key may be among those of some: a bitmap of fixed size, as a scalar subquery. An exact join must follow."""
    bits = bitmap(some.select(key.alias("k")), "k", BITS)
    one = rows.sparkSession.createDataFrame([(bits.view("int64").tolist(),)], "bits array<bigint>")
    h = F.xxhash64(key).bitwiseAND(F.lit((1 << BITS) - 1))
    word = F.get(one.scalar(), F.shiftright(h, 6).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    return rows.where(word.bitwiseAND(bit) != 0)


def _texts(lines: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """uid, line of the lines with a uid in ids (different uids)."""
    places = keep(classes.select("uid", "id", "doc_id", "line_no").join(ids, "uid"), "line-places")
    found = _among(lines, places, F.xxhash64("doc_id", "line_no")).select(digest(F.col("line")).alias("id"), "line")
    texts = keep(found.join(places.select("uid", "id"), "id").groupBy("uid").agg(F.first("line").alias("line")), "line-texts")
    forget(places)
    return texts


def links(lines: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (different a, b) whose lines have exact Jaccard similarity of percent or more over their shingles.

    Pairs whose signatures of a kind agree in fewer than SOME of DEPTH places are far below it and go unread.
    """
    sigs = lambda uid, w, a: classes.select(F.col("uid").alias(uid), F.col("sig_w").alias(w), F.col("sig_a").alias(a))
    agree = lambda x, y: F.coalesce(DEPTH * F.size(F.array_intersect(x, y)) >= SOME * F.least(F.size(x), F.size(y)), F.lit(False))
    close = pairs.join(sigs("a", "aw", "aa"), "a").join(sigs("b", "bw", "ba"), "b").where(agree("aw", "bw") | agree("aa", "ba"))
    close = keep(close.select("a", "b"), "line-close")
    texts = _texts(lines, classes, close.select(F.explode(F.array("a", "b")).alias("uid")).distinct())
    both = close.join(texts.select(F.col("uid").alias("a"), F.col("line").alias("s")), "a").join(texts.select(F.col("uid").alias("b"), F.col("line").alias("t")), "b")
    sets = both.select("a", "b", *[hashed(F.col(c)).alias(n) for c, n in (("s", "x"), ("t", "y"))])
    near = sets.where(100 * F.least(F.size("x"), F.size("y")) >= percent * F.greatest(F.size("x"), F.size("y")))
    common = F.size(F.array_intersect("x", "y"))
    linked = keep(near.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("n")).where(f"100 * c >= {percent} * (n - c)").select("a", "b"), "line-links")
    forget(close, texts)
    return linked


def line_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, line_no, keep_doc_id, keep_line_no, kept of every line of docs (doc_id bigint, text).

    Lines are parted by "\\n", trimmed of white space and lower-cased. Of each component of equal or linked lines
    the one of smallest (doc_id, line_no) stays. Blank lines (all of a null or empty text) are their own
    group and stay. Rows that repeat a doc_id repeat its lines; a null doc_id comes first in the order. An
    empty table gives no rows; long lines are compared whole; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    lines = lines_of(docs)
    rows = keep(bands(lines), "lines")
    classes = keep(classes_of(rows), "line-classes")
    rows = rows.select("doc_id", "line_no", "id")
    small, large = shared_bands(classes)
    pairs = keep(candidates(small, large), "line-pairs")
    linked = links(lines, classes, pairs, percent)
    forget(pairs)
    comp = components(linked).withColumnRenamed("id", "uid")
    for more in (lambda mixed: keep(across(mixed), "line-pairs"), lambda mixed: crowded(lines, classes, mixed, percent)):
        mixed = keep(_mixed(large, comp), "line-mixed")
        pairs = more(mixed)
        if pairs.limit(1).count():
            linked = linked.union(links(lines, classes, pairs, percent))
            comp = components(linked).withColumnRenamed("id", "uid")
        forget(mixed, pairs)
    first = F.struct("doc_id", "line_no")
    named = classes.select("uid", "id", first.alias("first")).join(comp, "uid", "left").select("id", "first", F.coalesce("comp", "uid").alias("comp"))
    stay = named.groupBy("comp").agg(F.min("first").alias("stay"))
    verdict = named.join(stay, "comp").select("id", "stay")
    return rows.join(verdict, "id", "left").select(
        "doc_id", "line_no",
        F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("stay.doc_id")).alias("keep_doc_id"),
        F.when(F.col("id").isNull(), F.col("line_no")).otherwise(F.col("stay.line_no")).alias("keep_line_no"),
        (F.col("id").isNull() | (F.col("stay.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stay.line_no") == F.col("line_no")))).alias("kept"),
    )


def without_repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with each text cut to its kept lines, in order (doc_id, text); a text without kept lines is empty."""
    kept = line_groups(docs, percent).where("kept").select("doc_id", "line_no").distinct()
    raw = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    parts = raw.join(kept, ["doc_id", "line_no"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("ls"))
    text = parts.select("doc_id", F.array_join(F.col("ls.raw"), "\n").alias("text"))
    return docs.select("doc_id").distinct().join(text, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def op7_fuzzy_lines(spark, sf_dir):
    return line_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# the same by comparing all lines, in DuckDB; the query may miss a few links near the threshold (see the tests)
EXACT_SQL = r"""
WITH RECURSIVE ln AS (
  SELECT doc_id, line_no - 1 AS line_no, lower(trim(ls[line_no], E' \t\r\x0B\x0C')) AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS ls FROM documents))),
cl AS (SELECT line, min({'d': doc_id, 'l': line_no}) AS f, row_number() OVER (ORDER BY min({'d': doc_id, 'l': line_no})) AS uid FROM ln WHERE line <> '' GROUP BY line),
sh AS (SELECT uid, unnest(CASE WHEN length(line) < 9 THEN [line] ELSE list_distinct(list_transform(range(1, length(line) - 7), lambda i: substr(line, i, 9))) END) AS t FROM cl),
sz AS (SELECT uid, count(*) AS n FROM sh GROUP BY uid),
sharing AS (SELECT a.uid AS x, b.uid AS y, count(*) AS c FROM sh a JOIN sh b ON a.t = b.t AND a.uid < b.uid GROUP BY 1, 2),
links AS (SELECT x, y FROM sharing JOIN sz p ON p.uid = x JOIN sz q ON q.uid = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x),
root AS (SELECT x, least(x, min(y)) AS r FROM reach GROUP BY x),
stays AS (SELECT cl.line, k.f FROM cl LEFT JOIN root ON root.x = cl.uid JOIN cl k ON k.uid = coalesce(root.r, cl.uid))
SELECT ln.doc_id, ln.line_no::INTEGER AS line_no, coalesce(f.d, ln.doc_id) AS keep_doc_id, coalesce(f.l, ln.line_no)::INTEGER AS keep_line_no,
       f IS NULL OR (f.d = ln.doc_id AND f.l = ln.line_no) AS kept
FROM ln LEFT JOIN stays ON stays.line = ln.line
"""
