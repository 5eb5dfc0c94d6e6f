"""Typed settings, read from spark.conf under `inkstone.`; unknown keys are ignored."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    max_upload_mb: int = 10
    max_tokens: int = 4096
    context_length: int = 1024
    grid_strength: float = 0.5
    margin_fraction: float = 0.08
    max_lines: int = 80
    questions_per_line: int = 3
    verify: bool = True
    reask: bool = False

    @classmethod
    def load(cls, spark: SparkSession) -> Settings:
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"inkstone.{f.name}", None)
            if value is not None:
                kind = type(f.default)
                found[f.name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
        return cls(**found)
