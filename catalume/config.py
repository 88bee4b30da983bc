"""Weights and thresholds, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults; ``from_session`` takes ``catalume.<name>`` of the session where set."""

    weights: dict[str, float] = field(
        default_factory=lambda: {"nome": 3.0, "perguntas": 4.0, "resumo": 1.0, "orgao": 2.0, "tags": 1.5}
    )
    confidence: dict[str, float] = field(default_factory=lambda: {"alta": 1.0, "media": 0.85, "baixa": 0.55})
    k1: float = 1.2
    b: float = 0.75
    idf_floor: float = 1e-6
    common_share: float = 0.15
    common_minimum: int = 50
    rrf_k: int = 60
    depth: int = 10
    limit: int = 5
    template_score: float = 35.0
    template_margin: float = 2.0
    relevant_score: float = 12.0
    blocker_minimum: int = 20
    blocker_share: float = 0.5
    rejection_limit: float = 0.05
    max_requests: int = 20
    window_seconds: int = 3600
    daily_cap: int = 400

    @classmethod
    def from_session(cls, spark: SparkSession) -> Settings:
        """A value that does not read as its field's type raises; weights and factors are ``catalume.weights.<column>`` and the like."""
        changed = {}
        for f in fields(cls):
            value = spark.conf.get(f"catalume.{f.name}", None)
            if value is not None and f.type in ("float", "int"):
                changed[f.name] = (float if f.type == "float" else int)(value)
        for name in ("weights", "confidence"):
            default = getattr(cls(), name)
            changed[name] = {key: float(spark.conf.get(f"catalume.{name}.{key}", str(value))) for key, value in default.items()}
        return replace(cls(), **changed)
