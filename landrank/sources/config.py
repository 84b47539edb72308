"""Run configuration from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from ..functions import thresholds as t

# Working coordinates and the default study area in them.
WORKING_CRS = "EPSG:2961"
DEFAULT_BBOX, DEFAULT_NAME = (360000, 4880000, 410000, 4930000), "lunenburg"


@dataclass
class Config:
    bbox: tuple[float, float, float, float] = DEFAULT_BBOX
    name: str = DEFAULT_NAME
    cell_size: float = t.CELL_SIZE
    crs: str = WORKING_CRS
    raw: Path = Path("data/raw")
    processed: Path = Path("data/processed")
    output: Path = Path("output")
    weights: dict[str, float] = field(default_factory=lambda: dict(t.WEIGHTS))
    enabled: list[str] = field(default_factory=lambda: list(t.WEIGHTS))
    deductions: dict[str, float] = field(default_factory=lambda: dict(t.DEDUCTIONS))
    overlap_threshold: float = t.OVERLAP_THRESHOLD
    least_parcel_acres: float = 1.0
    preferences: dict = field(default_factory=dict)

    @property
    def epsg(self) -> int:
        return int(str(self.crs).rpartition(":")[2])

    def scaled_weights(self) -> dict[str, float]:
        return t.scaled_weights(self.weights, self.enabled)


def load(path: str | Path = "config.yaml") -> Config:
    """The file's values over the defaults. A missing file and an enabled criterion without a weight are errors."""
    import yaml

    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"there is no configuration at {path}")
    raw = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    area, folders = raw.get("study_area") or {}, raw.get("paths") or {}
    out = Config(bbox=tuple(area.get("bbox", DEFAULT_BBOX)), name=area.get("name", DEFAULT_NAME))
    for ours, theirs in {"cell_size": "cell_size_m", "crs": "working_crs", "deductions": "confidence_deductions", "overlap_threshold": "exclusion_overlap_threshold", "least_parcel_acres": "min_parcel_area_acres"}.items():
        setattr(out, ours, raw.get(theirs, getattr(out, ours)))
    out.weights = raw.get("weights", out.weights)
    out.enabled = raw.get("enabled_criteria", list(out.weights))
    out.preferences = raw.get("preferences") or {}
    for name in ("raw", "processed", "output"):
        setattr(out, name, Path(folders.get(name, getattr(out, name))))
    if unweighted := [n for n in out.enabled if n not in out.weights]:
        raise ValueError(f"criteria without a weight: {', '.join(unweighted)}")
    return out
