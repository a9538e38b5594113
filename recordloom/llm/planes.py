"""Token ids as plane-shuffled, zstandard-compressed chunks, and back.

A payload is a run of chunks of CHUNK ids (the last may be shorter). A chunk is, little-endian: magic
"PLN1", kind (1: byte planes, 2: bit planes), number of planes, number of ids (uint32), compressed length
of each plane (uint32), then each plane as one zstandard frame. Byte plane k holds byte k of every id; bit
plane k holds bit k of every id, packed, so a chunk stores only as many planes as its largest id needs.
A row of the file table holds a run of whole documents in doc_id order with its chunk index (byte offset
and number of ids of each chunk) and document index (doc_id and number of ids of each document), so any
document is found and decoded from its row alone. Rows are stored as Parquet through Spark's committer.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import new_path, small_batches
from .tokens import CACHE, encoder

CHUNK = 1 << 16
"""Ids in a chunk."""
SEGMENT = 1 << 18
"""A row of the file table is closed after the document that brings it to this many ids."""

SCHEMA = "part int, segment int, doc_ids array<bigint>, doc_tokens array<bigint>, chunk_offsets array<bigint>, chunk_tokens array<bigint>, n_tokens bigint, payload binary"
_HEAD = struct.Struct("<4sBBI")


def pack_chunk(ids: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits:
        planes = [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), bitorder="little") for k in range(top)]
    else:
        planes = list(ids.view(np.uint8).reshape(-1, 4).T[: -(-top // 8)])
    blobs = [press.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return _HEAD.pack(b"PLN1", 2 if bits else 1, len(blobs), len(ids)) + struct.pack(f"<{len(blobs)}I", *map(len, blobs)) + b"".join(blobs)


def unpack_chunk(data: bytes) -> np.ndarray:
    import zstandard

    magic, kind, planes, n = _HEAD.unpack_from(data)
    if magic != b"PLN1":
        raise ValueError("not a chunk of plane-shuffled ids")
    sizes = struct.unpack_from(f"<{planes}I", data, _HEAD.size)
    at, ids, open_ = _HEAD.size + 4 * planes, np.zeros(n, np.uint32), zstandard.ZstdDecompressor()
    for k, size in enumerate(sizes):
        plane = np.frombuffer(open_.decompress(data[at : at + size]), np.uint8)
        at += size
        if kind == 2:
            ids |= np.unpackbits(plane, count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
        else:
            ids |= plane.astype(np.uint32) << np.uint32(8 * k)
    return ids


def _writer(path: str, end_id: int, bits: bool, cache_size: int):
    def run(batches):
        from pyspark import TaskContext

        part, segment = TaskContext.get().partitionId(), 0
        names, lengths, held, total = [], [], [], 0

        def close():
            ids = np.frombuffer(b"".join(held), "<u4")
            chunks = [pack_chunk(ids[k : k + CHUNK], bits) for k in range(0, len(ids), CHUNK)]
            offsets = np.cumsum([0, *map(len, chunks)])[:-1].tolist()
            tokens = [min(CHUNK, len(ids) - k) for k in range(0, len(ids), CHUNK)]
            return pa.RecordBatch.from_pylist(
                [{"part": part, "segment": segment, "doc_ids": names, "doc_tokens": lengths, "chunk_offsets": offsets, "chunk_tokens": tokens, "n_tokens": total, "payload": b"".join(chunks)}],
                schema=pa.schema([("part", pa.int32()), ("segment", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "doc_tokens", "chunk_offsets", "chunk_tokens")), ("n_tokens", pa.int64()), ("payload", pa.binary())]),
            )

        end = struct.pack("<I", end_id)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                piece = b.slice(at, 64)
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encoder(path, cache_size).encode(piece.column("text").to_pylist()), strict=True):
                    names.append(doc_id)
                    lengths.append(len(ids) // 4 + 1)
                    held += (ids, end)
                    total += lengths[-1]
                    if total >= SEGMENT:
                        yield close()
                        segment += 1
                        names, lengths, held, total = [], [], [], 0
        if names:
            yield close()

    return run


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = 0, bits: bool = False, cache_size: int = CACHE) -> None:
    """Encode every whole text (null: empty), append end_id to each and write the file table to out.

    cache_size bounds the pieces a worker remembers: less memory for more time.

    Documents stand in ascending doc_id order over the table: parts hold ranges of doc_id, segments follow
    each other within a part. Rows whose doc_id is null come first; rows that repeat a doc_id stay side by
    side. An empty table gives a table without rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    with small_batches(docs.sparkSession):
        rows.mapInArrow(_writer(path, end_id, bits, cache_size), SCHEMA).write.parquet(out)


def _documents(batches):
    for b in batches:
        for row in b.to_pylist():
            ends = [*row["chunk_offsets"][1:], len(row["payload"])]
            chunks = [unpack_chunk(row["payload"][a:z]) for a, z in zip(row["chunk_offsets"], ends, strict=True)]
            if [len(c) for c in chunks] != row["chunk_tokens"]:
                raise ValueError("a chunk does not hold what the index says")
            ids = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
            bounds = np.cumsum([0, *row["doc_tokens"]])
            crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(bounds[:-1] + row["before"], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from its decoded ids."""
    table = spark.read.schema(SCHEMA).parquet(out)
    parts = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per output file
    before, total = {}, 0
    for p in sorted(parts):
        before[p] = total
        total += parts[p]
    base = spark.createDataFrame(sorted(before.items()), "part int, base bigint")
    own = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    index = table.select("part", "segment", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("inside")).join(base, "part")
    index = index.select("part", "segment", (F.col("base") + F.col("inside")).alias("before"))
    return table.join(index, ["part", "segment"]).mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_token_planes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = new_path(spark, "token-files")
    write_token_files(docs, out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, out)
