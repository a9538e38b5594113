"""Mixing to target weights with soft domain membership."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import find, fixed_counts, labelled_sample
from .store import keep
from .textkit import groups, mix

SIZE = 1 << 18
LABELLED = 1 << 17
"""Most labelled documents that the domain classifier is fitted on."""
BEGINNINGS = (4, 6, 8)
"""Bytes of word beginnings that are features beside the words."""
CLEAR, LEAST, SHRINK = 5.0, 8, 10.0
RIDGE = 0.01
"""Weight of staying at rate 1 against meeting the targets."""
MOMENTUM = 0.8
ROUNDS = 500
"""Descents that have not settled by then are an error."""
_U = np.uint64


def _features(b: pa.RecordBatch):
    """(row, buckets of the distinct words and word beginnings) of each text."""
    for lo, _, h, bounds in groups(b.column("text"), BEGINNINGS):
        at = (h & _U(SIZE - 1)).astype(np.int64)
        for i in range(len(bounds) - 1):
            if bounds[i + 1] > bounds[i]:
                yield lo + i, int(bounds[i + 1] - bounds[i]), np.unique(at[bounds[i] : bounds[i + 1]])


def _feature_counts(shared, many: int):
    def count(b: pa.RecordBatch, total: np.ndarray) -> None:
        ids, domains = shared.value
        place = find(ids, b)
        rows = np.flatnonzero(place >= 0)
        if not len(rows):
            return
        own = domains[place[rows]]
        table, docs_of = total[: many * SIZE].reshape(many, SIZE), total[many * SIZE : many * SIZE + many]
        docs_of += np.bincount(own, minlength=many)
        for row, _, at in _features(b.take(pa.array(rows))):
            table[own[row]][at] += 1

    return count


def _evidence_sums(shared, many: int):
    def run(batches):
        logs = shared.value
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            z = np.zeros((b.num_rows, many))
            for row, size, at in _features(b):
                n[row] = size
                z[row] = logs[:, at].sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, many).astype(np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), lists], ["doc_id", "n_tokens", "z"])

    return run


def _inputs(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the calibration sees of a text: its evidence sums, plain and against its length, and a constant."""
    return np.concatenate([np.sign(z) * np.log1p(np.abs(z)), z / np.sqrt(np.maximum(n, 1))[:, None], np.ones((len(z), 1))], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def calibrate(x: np.ndarray, y: np.ndarray, many: int, rounds: int = 400) -> np.ndarray:
    """Weights of a softmax regression of y on x (inputs of _inputs), by gradient steps with momentum and a small ridge."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9) / 4
    u, want = x / scale, np.eye(many)[y]
    w = v = np.zeros((x.shape[1], many))
    step = 1.0 / max(0.25 * (u * u).sum(axis=1).mean(), 1e-9)
    for _ in range(rounds):
        v = 0.9 * v - step * (u.T @ (_softmax(u @ w) - want) / len(u) + 1e-5 * w)
        w = w + v
    return w / scale[:, None]


def _posteriors(shared, many: int):
    def run(batches):
        weights = shared.value
        for b in batches:
            z = b.column("z").flatten().to_numpy().reshape(-1, many)
            p = _softmax(_inputs(z, b.column("n_tokens").to_numpy()) @ weights)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, many).astype(np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), lists], ["doc_id", "n_tokens", "posterior"])

    return run


def evidence(table: np.ndarray, docs_of: np.ndarray) -> np.ndarray:
    """Log of how much likelier each feature is in each domain than in all, for features that clearly differ.

    table: documents with the feature by domain. A feature speaks for or against a domain only where its count
    there is off by more than CLEAR standard deviations (and at least LEAST documents have it), so that chance
    and single documents say nothing; counts are shrunk to the domain's share by SHRINK documents.
    """
    total = table.sum(axis=0)
    share = (docs_of / max(1, docs_of.sum()))[:, None]
    expected = total * share
    off = (table - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    clear = (np.abs(off) > CLEAR) & (np.maximum(table, expected) >= LEAST)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log((table + SHRINK * share) / ((total + SHRINK) * share))
    return np.where(clear & (share > 0), ratio, 0.0)


def domain_posteriors(docs: DataFrame, ids: np.ndarray, domains: np.ndarray, names: list[str]) -> DataFrame:
    """doc_id, n_tokens (words), posterior over names, of every row.

    ids, domains: sorted labelled doc_ids and the place of their domain in names. Evidence of hashed words and
    word beginnings is counted on two thirds of them; on the last third a softmax regression turns a text's
    evidence into posteriors. Without labels all domains are alike. Null and wordless texts have no evidence.
    """
    sc, many = docs.sparkSession.sparkContext, len(names)
    docs, domains = docs.select("doc_id", "text"), domains.astype(np.int64)
    last = mix(ids.astype(np.uint64)) % _U(3) == 0
    total = fixed_counts(docs, many * SIZE + -(-many // 16) * 16, _feature_counts(sc.broadcast((ids[~last], domains[~last])), many))
    logs = evidence(total[: many * SIZE].reshape(many, SIZE), total[many * SIZE : many * SIZE + many])
    sums = keep(docs.mapInArrow(_evidence_sums(sc.broadcast(logs.astype(np.float32)), many), "doc_id bigint, n_tokens bigint, z array<double>"), "evidence")
    held = sc.broadcast(ids[last])

    def labelled(batches):
        for b in batches:
            yield b.filter(pa.array(find(held.value, b) >= 0))

    rows = sums.mapInArrow(labelled, sums.schema).toArrow()  # a third of the labelled sample, LABELLED / 3 rows at most
    weights = np.zeros((2 * many + 1, many))
    if rows.num_rows:
        rows = rows.combine_chunks()
        z = rows["z"].combine_chunks().flatten().to_numpy().reshape(-1, many)
        y = domains[last][np.searchsorted(ids[last], rows["doc_id"].to_numpy())]
        weights = calibrate(_inputs(z, rows["n_tokens"].to_numpy()), y, many)
    return sums.mapInArrow(_posteriors(sc.broadcast(weights), many), "doc_id bigint, n_tokens bigint, posterior array<double>")


def _rates(w_p: np.ndarray, steps: list[np.ndarray], eta: float) -> tuple[np.ndarray, np.ndarray]:
    """(rates, points of the next gradient) of documents with posteriors w_p after the given gradient steps; a step: the
    price of each domain."""
    r = y = np.ones(len(w_p))
    for g in steps:
        new = np.maximum(0.0, y - eta * (w_p @ g + RIDGE * (y - 1)))
        r, y = new, new + MOMENTUM * (new - r)
    return r, y


def _posterior_matrix(b: pa.RecordBatch, many: int) -> np.ndarray:
    return b.column("posterior").flatten().to_numpy().reshape(-1, many)


def fit_rates(member: DataFrame, targets: np.ndarray) -> list[np.ndarray]:
    """Steps of projected-gradient least squares over all rows of member (n_tokens, posterior).

    Minimises sum_d (sum_i r_i t_i p_id - T_d)^2 / S_d + RIDGE * sum_i t_i (r_i - 1)^2, r_i >= 0, S_d the
    expected tokens of domain d at rate 1. In units of t_i the Hessian's largest eigenvalue is 1 + RIDGE, so
    the fixed step 1 / (1 + RIDGE) converges, with momentum in about the root of 1 / RIDGE rounds. A step is one number for each domain; each round sums one
    vector of that size over the rows, in tasks, and rates follow from the steps.
    """
    many, eta = len(targets), 1 / (1 + RIDGE)
    sc = member.sparkSession.sparkContext
    steps: list[np.ndarray] = []
    names = [f"t{d}" for d in range(many)]
    schema = ", ".join(f"{n} double" for n in names)
    have = None
    for _ in range(ROUNDS):
        shared = sc.broadcast(list(steps))

        def run(batches, shared=shared):
            total = np.zeros(many)
            for b in batches:
                p = _posterior_matrix(b, many)
                total += (_rates(p, shared.value, eta)[1] * b.column("n_tokens").to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names)

        row = member.mapInArrow(run, schema).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names]).first()
        got = np.array([row[n] for n in names])
        shared.unpersist()
        if have is None:
            have = np.maximum(got, 1e-9)
        step = (got - targets) / have
        if len(steps) > 1 and max(np.abs(step - old).max() for old in steps[-2:]) < 1e-4:
            return steps
        steps.append(step)
    raise RuntimeError(f"rates did not settle in {ROUNDS} rounds")


def mix_rates(member: DataFrame, targets: np.ndarray) -> DataFrame:
    """member (doc_id, n_tokens, posterior), kept in a table, with rate >= 0 of each row.

    Expected tokens of each domain, sum of rate * n_tokens * posterior, come near the targets (least
    squares; exact where nonnegative rates can meet them, up to RIDGE). An empty table gives no rows.
    """
    steps, many = fit_rates(member, targets), len(targets)
    shared = member.sparkSession.sparkContext.broadcast(steps)

    def run(batches):
        for b in batches:
            r, _ = _rates(_posterior_matrix(b, many), shared.value, 1 / (1 + RIDGE))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], [*b.schema.names, "rate"])

    return member.mapInArrow(run, "doc_id bigint, n_tokens bigint, posterior array<double>, rate double")


NAMES = ["plain", "plain_toxic", "fine", "fine_toxic"]
WEIGHTS = {"plain": 1.1, "plain_toxic": 0.0, "fine": 1.2, "fine_toxic": 0.0}
"""Target tokens of each labelled domain as a multiple of what the documents hold: no toxic text, more of the rest."""


def _members(spark, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domain = labels.select("doc_id", (2 * F.col("quality") + F.col("toxic")).alias("domain")).where("domain between 0 and 3")
    ids, domains = labelled_sample(domain, "domain", LABELLED)
    member = keep(domain_posteriors(docs, ids, domains, NAMES), "members")
    held = member.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("posterior")[d]), F.lit(0.0)).alias(f"t{d}") for d in range(len(NAMES))]).first()
    return member, np.array([held[f"t{d}"] * WEIGHTS[n] for d, n in enumerate(NAMES)])


def op10_soft_mixing(spark, sf_dir):
    member, targets = _members(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    return mix_rates(member, targets).select(
        "doc_id", "n_tokens", *[F.col("posterior")[d].alias(f"p_{n}") for d, n in enumerate(NAMES)], "rate"
    )


def stage_mixing(spark, docs, sf_dir):
    """Pipeline stage: a document of rate r stands floor(r) times, and once more when a uniform hash of its doc_id lies
    under the rest of r; so the expected domain tokens of the result meet the targets (up to RIDGE).

    Clean text has targets above what there is (WEIGHTS) and rates over 1, so it stays, some of it twice; toxic text
    has target 0. Rows without doc_id go. Of rows that repeat a doc_id each stands as often as the one of the largest rate; null and
    wordless texts have no tokens and the domains' prior as posterior. An empty table gives no rows. Other columns go.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    member, targets = _members(spark, docs, sf_dir)
    u = (F.xxhash64("doc_id", F.lit("mix")).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    copies = (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("bigint")).alias("copies")
    times = mix_rates(member, targets).where("doc_id is not null").select("doc_id", copies).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    return docs.join(times, "doc_id").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
