"""Parameters of k-mer analysis, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class KmerConfig:
    k: int = 31  #: k-mer length, 3 to 95
    m: int = 17  #: minimizer length, below k
    min_count: int = 15  #: counts outside [min_count, max_count] are dropped, not clamped
    max_count: int = 40
    max_supermer_len: int = 250  #: bases
    heavy_ratio: float = 2.3  #: a task is heavy above this multiple of the mean
    dispatch_limit: float = 1.5  #: load of a worker against the mean at which balancing gives up
    dispatch_step: float = 0.05

    def __post_init__(self):
        check_length("k", self.k)
        if not 1 <= self.m < self.k:
            raise ValueError(f"m must be from 1 to k - 1, not {self.m}")
        check_band(self.min_count, self.max_count)
        if self.max_supermer_len < self.k:
            raise ValueError("max_supermer_len must be at least k")


def check_length(name: str, value: int) -> None:
    if not 2 < value < 96:
        raise ValueError(f"{name} must be from 3 to 95, not {value}")


def check_band(min_count: int, max_count: int) -> None:
    if not 0 < min_count <= max_count <= 65535:
        raise ValueError(f"0 < min_count <= max_count <= 65535 must hold, not {min_count}, {max_count}")
