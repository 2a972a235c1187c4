"""Frozen parameters.  ``Params().replace(threshold=2.0)`` gives a changed copy; nothing is shared or mutable."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

#: The default rows a side of a tile, by method.
TILE_ROWS = MappingProxyType(
    {
        "brute_force": 25_000,
        "cuvs_ivf_flat": 1_000_000,
        "cuvs_cagra": 1_000_000,
        "cuvs_brute_force": 100_000,
        "centroid_join": 1_000_000,
        "centroid_batch": 25_000,
        "centroid_centroid": 1_000_000,
    }
)


@dataclass(frozen=True)
class GraphParams:
    k: int = 64
    itopk_size: int = 64

    @property
    def beam(self) -> int:
        """The beam is never narrower than the result."""
        return max(self.k, self.itopk_size)


@dataclass(frozen=True)
class IvfParams:
    k: int = 64
    n_lists: int = 1024
    n_probes: int = 20


@dataclass(frozen=True)
class KnnParams:
    k: int = 32


@dataclass(frozen=True)
class CentroidParams:
    sample_fraction: float = 0.2
    n_clusters: int = 4096
    k_db_candidates: int = 32_768
    use_ivf: bool = False


@dataclass(frozen=True)
class BatchParams:
    sample_fraction: float = 0.25
    centroid_threshold: float | None = 50_000.0
    mode: str = "centroid"  # or "bound", which loses no pair


@dataclass(frozen=True)
class Params:
    threshold: float = 100_000.0
    tile_rows: MappingProxyType = field(default_factory=lambda: TILE_ROWS)
    cuvs_cagra: GraphParams = GraphParams()
    cuvs_ivf_flat: IvfParams = IvfParams()
    cuvs_brute_force: KnnParams = KnnParams()
    centroid_join: CentroidParams = CentroidParams()
    centroid_batch: BatchParams = BatchParams()
    seed: int = 42

    def replace(self, **changes: Any) -> "Params":
        """A copy; a dict for a nested group changes only the fields it names."""
        out = {}
        for k, v in changes.items():
            now = getattr(self, k)
            if isinstance(v, dict):
                v = MappingProxyType({**now, **v}) if isinstance(now, MappingProxyType) else dataclasses.replace(now, **v)
            out[k] = v
        return dataclasses.replace(self, **out)

    def as_dict(self) -> dict[str, Any]:
        """Plain values, for metadata."""
        return {f.name: dict(v) if isinstance(v := getattr(self, f.name), MappingProxyType) else dataclasses.asdict(v) if dataclasses.is_dataclass(v) else v for f in dataclasses.fields(self)}
