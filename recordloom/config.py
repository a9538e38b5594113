"""Settings of the linkage pipeline."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from recordloom.sources.store import fingerprint


@dataclass
class Config:
    ks: dict[str, int] = field(default_factory=lambda: {"name": 30, "addr": 20, "both": 30})
    key_k: int = 30
    max_df: int = 40
    rev_k: int = 3
    hop_k: int = 3
    max_train_pairs: int = 20_000_000
    train_frac: float = 1.0

    def block_fingerprint(self) -> str:
        """Changes when a setting that candidates depend on does."""
        return fingerprint({k: v for k, v in asdict(self).items() if k not in ("max_train_pairs",)})


SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "recordloom", **extra: str):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName(app)
    for k, v in {**SESSION, **extra}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
