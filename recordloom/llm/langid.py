"""Language identification with language-bitmask n-gram filters."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import _LOWER, _SPACE, _buffers, mix
from .store import keep

LOG2_SLOTS = 21
HASHES = 3
GRAMS = 4000
"""n-grams learned for each language; with LOG2_SLOTS it bounds the model that is broadcast."""
SLICE = 64
WIDTH = 4
_LETTER = re.compile(r"[^\W\d_]")
_U = np.uint64


def _grams(raw: np.ndarray) -> np.ndarray:
    """The WIDTH-byte grams of bytes: A-Z lower-cased, white space as one space, digits as 0; one code per byte."""
    b = np.where(_SPACE[raw], np.uint8(32), _LOWER[raw])
    b = np.where((b >= 48) & (b <= 57), np.uint8(48), b).astype(np.uint32)
    if len(b) < WIDTH:
        return np.zeros(0, np.uint32)
    n = len(b) - WIDTH + 1
    out = b[:n].copy()
    for k in range(1, WIDTH):
        out |= b[k : k + n] << np.uint32(8 * k)
    return out


def _texts(batch: pa.RecordBatch, most: int = 1 << 18):
    """(first row, end row, grams, bounds) of runs of rows of about most bytes; a longer text comes in pieces."""
    raw, off = _buffers(batch.column("text"))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = min(max(int(np.searchsorted(off, off[lo] + most, side="right")) - 1, lo + 1), n)
        if off[hi] - off[lo] <= most:
            # each text is framed by spaces, so that its edges are edges of words and no gram spans two texts
            lens = np.diff(off[lo : hi + 1])
            begin = np.concatenate([[0], np.cumsum(lens + 2)])
            buf = np.full(int(begin[-1]), 32, np.uint8)
            where = np.repeat(begin[:-1] + 1 - (off[lo:hi] - off[lo]), lens) + np.arange(int(off[hi] - off[lo]))
            buf[where] = raw[off[lo] : off[hi]]
            grams = _grams(buf)
            whole = np.zeros(len(grams) + 1, bool)
            owner = np.repeat(np.arange(hi - lo), lens + 2)
            if len(grams):
                whole[: len(grams)] = owner[: len(grams)] == owner[WIDTH - 1 : WIDTH - 1 + len(grams)]
            yield lo, hi, grams[whole[: len(grams)]], owner[: len(grams)][whole[: len(grams)]]
        else:
            at, end = int(off[lo]), int(off[hi])
            while at < end:
                stop = min(at + most, end)
                piece = np.concatenate([[32] * int(at == off[lo]), raw[at : min(stop + WIDTH - 1, end)], [32] * int(stop == end)]).astype(np.uint8)
                grams = _grams(piece)
                yield lo, hi, grams, np.zeros(len(grams), np.int64)
                at = stop
        lo = hi


def _count(langs_col: str):
    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(lang, grams):
            u, n = np.unique(grams, return_counts=True)
            if lang in held:
                u0, n0 = held[lang]
                u2, inv = np.unique(np.concatenate([u0, u]), return_inverse=True)
                held[lang] = u2, np.bincount(inv, weights=np.concatenate([n0, n])).astype(np.int64)
            else:
                held[lang] = u, n.astype(np.int64)

        for b in batches:
            langs = np.array(b.column(langs_col).to_pylist(), object)
            for lo, hi, grams, owner in _texts(b):
                of = langs[lo:hi]
                for lang in dict.fromkeys(of.tolist()):
                    fold(lang, grams[(of == lang)[owner]])
        for lang, (u, n) in held.items():
            for at in range(0, len(u), 65536):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(u[at : at + 65536])), pa.array(u[at : at + 65536].astype(np.int64)), pa.array(n[at : at + 65536])], ["lang", "gram", "n"]
                )

    return run


class Model:
    """Bit-sliced Bloom filters: slot s of slice k holds one bit for each of languages 64k to 64k + 63."""

    def __init__(self, rows) -> None:
        self.langs = sorted({r[0] for r in rows})
        self.slots = np.zeros((max(1, -(-len(self.langs) // SLICE)), 1 << LOG2_SLOTS), _U)
        for k, lang in enumerate(self.langs):
            at = self._at(np.array([r[1] for r in rows if r[0] == lang], np.uint32))
            for a in at:
                self.slots[k // SLICE][a] |= _U(1) << _U(k % SLICE)
        fill = [float(((self.slots[k // SLICE] >> _U(k % SLICE)) & _U(1)).mean()) for k in range(len(self.langs))]
        self.false_rate = np.array(fill) ** HASHES

    @staticmethod
    def _at(grams: np.ndarray) -> list[np.ndarray]:
        h = mix(grams.astype(_U) + _U(0x9E3779B97F4A7C15))
        return [((h >> _U(LOG2_SLOTS * k)) & _U((1 << LOG2_SLOTS) - 1)).astype(np.int64) for k in range(HASHES)]

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each slice, the languages that may contain each n-gram."""
        at = self._at(grams)
        out = self.slots[:, at[0]]
        for a in at[1:]:
            out &= self.slots[:, a]
        return out


def learn(docs: DataFrame) -> Model:
    """A model from rows of docs with text and non-null lang: the GRAMS most frequent n-grams of each language.

    All rows are counted; on the driver come only the chosen n-grams (languages x GRAMS rows).
    """
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = rows.mapInArrow(_count("lang"), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= GRAMS).select("lang", "gram")
    return Model([(r["lang"], r["gram"]) for r in best.collect()])


def _predict(shared):
    def run(batches):
        model: Model = shared.value
        for b in batches:
            n, many = b.num_rows, len(model.langs)
            hits, total = np.zeros((n, many)), np.zeros(n)
            for lo, hi, grams, owner in _texts(b):
                masks = model.masks(grams)
                total[lo:hi] += np.bincount(owner, minlength=hi - lo)
                for k in range(many):
                    bit = ((masks[k // SLICE] >> _U(k % SLICE)) & _U(1)).astype(np.float64)
                    hits[lo:hi, k] += np.bincount(owner, weights=bit, minlength=hi - lo)
            share = hits / np.maximum(total, 1)[:, None]
            share = np.clip((share - model.false_rate) / (1 - model.false_rate), 0, 1) if many else share
            lettered = np.array([t is not None and bool(_LETTER.search(t)) for t in b.column("text").to_pylist()], bool)
            best = share.argmax(axis=1) if many else np.zeros(n, int)
            # the winner's share of n-grams against the runner-up's
            order = np.sort(share, axis=1) if many else share
            first = order[:, -1] if many else np.zeros(n)
            second = order[:, -2] if many > 1 else np.zeros(n)
            score = np.where(first + second > 0, first / np.maximum(first + second, 1e-12), 0.0)
            pred = [model.langs[k] if ok and many else "und" for k, ok in zip(best, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in b.schema.names if c != "text"), pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(np.where(lettered, first, 0.0))],
                [*(c for c in b.schema.names if c != "text"), "lang_pred", "score", "share"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs but text, with lang_pred, score and share (which replace columns of these names).

    lang_pred is the language whose filter holds the largest share of the text's n-grams, corrected by the
    filter's false-positive rate (fill ** HASHES); `und` with score 0 where the text is null or has no letter.
    score, 0 to 1: that share against it and the runner-up's together; share: that share itself. Ties go to the
    first name. A null doc_id is predicted like any, a repeated row as often as it stands there. A table
    without rows gives none; without learned languages all is `und`. Whole texts are read, in pieces.
    """
    docs = docs.drop("lang_pred", "score", "share")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_predict(shared), f"{kinds}, lang_pred string, score double, share double")


def held_out(part: int = 2, of: int = 4):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == part, F.lit(False))


def op9_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out())
    model = learn(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model)


FLOOR = 0.5
"""A text is rejected below this part of the share that all but one in a hundred learned texts of a language reach."""


def stage_language_id(spark, docs, sf_dir):
    """Pipeline stage: keep the documents that a language explains.

    Those go whose prediction is `und` (null, empty, no letter), or whose best language holds a smaller share of their
    n-grams than FLOOR times the first percentile of that share among the texts the language was learned from; so
    gibberish and languages never learned go whatever single n-grams they hit by chance. Rows without doc_id go;
    of a repeated doc_id all rows stay if one of them is kept. An empty table gives no rows, one without
    labelled languages none either (all is `und`). Other columns go.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = learn(docs.where(~held_out()))
    said = keep(predict(docs.select("doc_id", "lang", "text"), model), "languages").where("lang_pred <> 'und'")
    learned = said.where(~held_out() & (F.col("lang") == F.col("lang_pred")))
    floors = learned.groupBy("lang_pred").agg((FLOOR * F.percentile_approx("share", 0.01, 1000)).alias("floor"))
    stay = said.join(F.broadcast(floors), "lang_pred", "left").where("share >= coalesce(floor, 0)")  # one row for each language
    return docs.join(stay.select("doc_id").distinct(), "doc_id", "left_semi")
