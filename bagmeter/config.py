"""Fixed values of the domain and defaults of the pipelines."""

from __future__ import annotations

from dataclasses import dataclass

#: Beat symbols of the multiclass problem, in ascending order.
LABELS = ("A", "L", "N", "R", "V")
#: Fixed value: the healthy class, from which burden is counted.
BASE_LABEL = "N"
#: Prevalence bands of each label as fractions [lo, hi), the last one closed.
CLINICAL_RANGES = {
    "V": [(0.0, 0.05), (0.05, 0.10), (0.10, 0.40)],
    "A": [(0.0, 0.01), (0.01, 0.02), (0.02, 0.15)],
    "L": [(0.0, 0.01), (0.01, 1.0)],
    "R": [(0.01, 1.0)],
}
#: How often each band is drawn.
ZONE_WEIGHTS = {"V": [0.2, 0.3, 0.5], "A": [0.2, 0.3, 0.5], "L": [0.5, 0.5], "R": [1.0]}
#: Names of the bands.
RISK_ZONE_LABELS = {
    "V": ["low_risk", "gray_zone", "high_risk"],
    "A": ["low_risk", "gray_zone", "high_risk"],
    "L": ["low_risk_intermittent", "high_risk_continuous"],
    "R": ["contextual_risk"],
}


@dataclass(frozen=True)
class BagConfig:
    """Parameters of a bag protocol."""

    ranges: dict[str, list[tuple[float, float]]]
    weights: dict[str, list[float]]
    base_label: str = BASE_LABEL
    seed: int = 7

    def __post_init__(self) -> None:
        for label, bands in self.ranges.items():
            if len(self.weights.get(label, [1.0] * len(bands))) != len(bands):
                raise ValueError(f"{label}: one weight per band is needed")


CLINICAL = BagConfig(CLINICAL_RANGES, ZONE_WEIGHTS)
