"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet and
read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers

from recordloom.llm import decontam, langid, mixing, near_dup, planes
from recordloom.llm.store import keep, new_path


def token_output(spark, docs, sf_dir):
    """Token files of the documents, read back: doc_id, start, n_tokens, ids_crc32."""
    out = new_path(spark, "token-files")
    planes.write_token_files(docs, out, public_tokenizers.path("byte_bpe_50k.json"), cache_size=100_000)  # workers hold other stages' models too
    return planes.read_token_files(spark, out)


STAGES = [
    ("language_id", langid.stage_language_id),
    ("near_duplicates", near_dup.stage_near_duplicates),
    ("decontamination", decontam.stage_decontamination),
    ("mixing", mixing.stage_mixing),
    ("token_output", token_output),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
