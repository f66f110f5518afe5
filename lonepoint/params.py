"""Parameters of a detector, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """window and slide count points; a point is an outlier in a window with fewer than k others within radius."""

    window: int
    slide: int
    radius: float
    k: int

    def __post_init__(self):
        if self.slide <= 0 or self.window <= 0:
            raise ValueError("window and slide must be positive")
        if self.window % self.slide:
            raise ValueError(f"slide {self.slide} does not divide window {self.window}")
        if not (self.radius > 0 and math.isfinite(self.radius)):
            raise ValueError("radius must be positive and finite")
        if self.k < 0:
            raise ValueError("k must not be negative")

    @property
    def n(self) -> int:
        """Slides that are resident together."""
        return self.window // self.slide


@dataclass(frozen=True)
class LshParams:
    """tables of hashes p-stable hashes each, of this width, drawn with the seed."""

    tables: int
    hashes: int
    width: float
    seed: int

    def __post_init__(self):
        if self.tables < 1 or self.hashes < 1:
            raise ValueError("tables and hashes must be positive")
        if not (self.width > 0 and math.isfinite(self.width)):
            raise ValueError("the hash width must be positive and finite")
