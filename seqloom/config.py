"""Parameters of a counting run."""

from __future__ import annotations

from dataclasses import dataclass

FILTERS = ("default", "signature", "canonical")


@dataclass(frozen=True)
class CountConfig:
    """k: length of k-mers (1 to 64); p: of minimizers; parts: partitions by minimizer; hpc: compress runs of one base first."""

    k: int = 21
    p: int = 7
    parts: int = 31
    pmer_filter: str = "default"
    hpc: bool = False
    min_freq: int = 1
    max_freq: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.k <= 64:
            raise ValueError("k must be from 1 to 64")
        if not 3 <= self.p <= 16:
            raise ValueError("p must be from 3 to 16")
        if self.p > self.k:
            raise ValueError("p must not exceed k")
        if self.parts < 1:
            raise ValueError("parts must be at least 1")
        if self.pmer_filter not in FILTERS:
            raise ValueError(f"pmer_filter must be one of {FILTERS}")
        if self.min_freq < 0 or self.max_freq is not None and self.max_freq < self.min_freq:
            raise ValueError("frequencies out of order")
