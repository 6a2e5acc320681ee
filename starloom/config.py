"""Settings of the library: defaults, then the environment (STARLOOM_*), then what is given."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from .errors import StarloomError


@dataclass(frozen=True)
class Config:
    scd_type: int = 2
    epoch: str = "1970-01-01"
    infinity: str = "9999-12-31"
    checksum: str = "md5"
    batch_size: int = 10_000
    cache_tables: bool = True
    allow_destructive: bool = False
    shuffle_partitions: int = 0
    max_partition_bytes: str = "128m"
    skew_join: bool = True

    def __post_init__(self):
        if self.checksum not in ("md5", "sha1", "sha256"):
            raise StarloomError(f"no checksum {self.checksum!r}")
        if self.scd_type not in (1, 2, 3, 6):
            raise StarloomError(f"no dimension type {self.scd_type}")

    @classmethod
    def load(cls, environment=None, prefix: str = "STARLOOM_", **given) -> Config:
        env = os.environ if environment is None else environment
        found = {}
        for f in fields(cls):
            text = env.get(prefix + f.name.upper())
            if text is not None:
                kind = type(f.default)
                try:
                    found[f.name] = text.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
                except ValueError:
                    raise StarloomError(f"{prefix}{f.name.upper()}={text!r} is no {kind.__name__}") from None
        return cls(**(found | given))

    def spark(self) -> dict[str, str]:
        """Session settings."""
        out = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": str(self.skew_join).lower(), "spark.sql.files.maxPartitionBytes": self.max_partition_bytes, "spark.sql.session.timeZone": "UTC"}
        return out | ({"spark.sql.shuffle.partitions": str(self.shuffle_partitions)} if self.shuffle_partitions else {})

    def hashed(self, column):
        from pyspark.sql import functions as F

        return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}[self.checksum](column)
