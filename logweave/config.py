"""Plain parameters of the engine (no environment loading)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Fixed values (defaults that must equal the reference's behaviour)
    log_year: int = 2024
    search_top_k: int = 20
    semantic_overfetch: int = 20
    embedding_dim: int = 384
    anomaly_n_estimators: int = 100
    anomaly_max_samples: int = 256
    anomaly_contamination: float = 0.05
    anomaly_seed: int = 42
    alert_severity_threshold: str = "high"
    frequent_errors_limit: int = 15
    semantic_event_ids_top_k: int = 200
    semantic_event_ids_max: int = 5
    source_name: str = "OpenSSH"


DEFAULT = Settings()
