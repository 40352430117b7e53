"""Settings of a monitoring project, read from JSON and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Every setting has a default; values that contradict each other are refused."""

    name: str = "riskmon"
    seed: int = 42
    id_column: str = "TransactionID"
    time_column: str = "TransactionDT"
    label_column: str = "isFraud"
    amount_column: str = "TransactionAmt"
    entity_column: str = "card1"
    expected_files: tuple[str, ...] = ("train_transaction.csv", "train_identity.csv")
    later_files: tuple[str, ...] = ("test_transaction.csv", "test_identity.csv")
    period_ends: tuple[float, ...] = (0.5, 0.6, 0.7, 1.0)
    development_blocks: int = 5
    batch_seconds: int = 604_800
    label_delay: int = 2
    review_rates: tuple[float, ...] = (0.005, 0.01, 0.02, 0.05)
    review_rate: float = 0.02
    cardinality_limit: int = 500
    missing_threshold: float = 0.995
    trials: int = 20
    warning_quantile: float = 0.95
    critical_quantile: float = 0.99
    iterations: int = 500
    minimum_positive: int = 30
    minimum_negative: int = 30
    top_features: int = 25

    def __post_init__(self) -> None:
        ends = self.period_ends
        checks = {
            "period_ends must be four increasing shares, the last of them 1": len(ends) == 4 and 0 < ends[0] < ends[1] < ends[2] < ends[3] == 1,
            "expected_files and later_files must be two tables each": len(self.expected_files) == len(self.later_files) == 2,
            "development_blocks must be at least 3": self.development_blocks >= 3,
            "batch_seconds must be positive": self.batch_seconds > 0,
            "label_delay must not be negative": self.label_delay >= 0,
            "review_rates must lie between 0 and 1": bool(self.review_rates) and all(0 < r < 1 for r in self.review_rates),
            "review_rate must be one of review_rates": self.review_rate in self.review_rates,
            "cardinality_limit must be at least 2": self.cardinality_limit >= 2,
            "missing_threshold must lie in (0, 1]": 0 < self.missing_threshold <= 1,
            "trials and iterations must be positive": min(self.trials, self.iterations) >= 1,
            "quantiles must increase between 0 and 1": 0 < self.warning_quantile < self.critical_quantile < 1,
            "minimum_positive and minimum_negative must be positive": min(self.minimum_positive, self.minimum_negative) >= 1,
        }
        broken = [text for text, met in checks.items() if not met]
        if broken:
            raise ValueError("; ".join(broken))


def load(path: str | None = None) -> Settings:
    """Settings of a JSON file, or the defaults; unknown names are refused."""
    given = json.loads(Path(path).read_text()) if path else {}
    if not isinstance(given, dict):
        raise ValueError("settings must be an object")
    unknown = set(given) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
