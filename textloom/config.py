"""Defaults of the operators, overridable per call or per dataset."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Thresholds:
    """Fixed default values of the quality rules; a None override keeps the default, zero counts."""

    min_length: float = 10
    max_length: float = 100_000
    repetition: float = 0.3
    spam: float = 0.7
    code: float = 0.5
    toxicity: float = 0.8
    pii: float = 0.5
    minhash: float = 0.7

    def over(self, **values) -> Thresholds:
        known = asdict(self)
        return replace(self, **{k: v for k, v in values.items() if k in known and v is not None})
