"""Settings of the workflows; the defaults are fixed values users rely on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SketchConfig:
    kmer_size: int = 21
    sketch_size: int = 100_000
    min_cov: int = 2
    assembly: bool = False
    track_cov: bool = False

    def __post_init__(self):
        if self.kmer_size < 1:
            raise ValueError("kmer_size must be positive")
        if self.sketch_size < 1:
            raise ValueError("sketch_size must be positive")

    @property
    def effective_min_cov(self) -> int:
        """Assemblies keep every k-mer; reads never keep a k-mer seen once."""
        return 1 if self.assembly else max(2, self.min_cov)


@dataclass(frozen=True)
class DistanceConfig:
    kmer_size: int = 21
    jaccard_distance: bool = False


@dataclass(frozen=True)
class QueryConfig:
    normalize: bool = False


@dataclass(frozen=True)
class TreeDrawing:
    height: int = 1000
    width: int = 1000
    font_size: int = 14
    line_width: float = 1.0
    min_frequency: float = 0.005
    equal_dist: bool = False
    include_id: bool = False


@dataclass(frozen=True)
class LabelDrawing:
    height: int = 1000
    width: int = 1000
    font_size: int = 14
    line_width: int = 2
    normalize: bool = False
    min_proportion: float = 0.0
