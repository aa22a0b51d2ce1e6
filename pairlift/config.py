"""Run configuration and its command line."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field

#: Milliseconds of a window unit.
UNITS = {"MILLISECONDS": 1, "SECONDS": 1_000, "MINUTES": 60_000, "HOURS": 3_600_000, "DAYS": 86_400_000}


def unit_ms(name: str) -> int:
    """Milliseconds of a unit name, in any case."""
    try:
        return UNITS[name.strip().upper()]
    except KeyError:
        raise ValueError(f"unknown window unit {name!r}; one of {', '.join(UNITS)}") from None


def parse_seed(text: str) -> int:
    """A signed 64-bit number, in hex after 0x, else decimal."""
    value = int(text, 16) if text.lower().startswith(("0x", "-0x")) else int(text)
    if not -(1 << 63) <= value < 1 << 63:
        raise ValueError(f"seed {text!r} is outside of 64 bits")
    return value


@dataclass(frozen=True)
class Config:
    """What a run needs.

    ``drop_zero_cells`` and ``contingency`` depart from the defaults that define the scores: cells that fell
    back to zero are scored, and k22 = N + k11 - k12 - k21 ("textbook": N - k11 - k12 - k21).
    """

    input: str
    window_size: int
    window_unit: str = "MILLISECONDS"
    skip_cuts: bool = False
    item_cut: int = 500
    user_cut: int = 500
    top_k: int = 10
    seed: int = field(default_factory=time.time_ns)
    buffer_timeout: int = 100  # accepted, without a meaning here
    drop_zero_cells: bool = False
    contingency: str = "observed"
    score_decimals: int | None = None  # None ranks on full precision
    recursive: bool = False
    modified_after: str | None = None
    interval: int | None = None  # milliseconds between looks for new files; None reads once

    def __post_init__(self) -> None:
        unit_ms(self.window_unit)
        if self.top_k <= 0:
            raise ValueError("top_k has to be positive")
        if self.window_size <= 0:
            raise ValueError("window_size has to be positive")
        if self.interval is not None and self.interval < 1:
            raise ValueError("interval has to be 1 ms at least")
        if self.contingency not in ("observed", "textbook"):
            raise ValueError(f"unknown contingency {self.contingency!r}")

    @property
    def window_ms(self) -> int:
        return self.window_size * unit_ms(self.window_unit)

    def describe(self) -> str:
        return "\n".join(f"{k}\t{hex(v) if k == 'seed' else v}" for k, v in vars(self).items())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairlift", description="Top partners of each item from user,item,timestamp lines.")
    p.add_argument("-i", "--input", required=True, help="file or folder of lines")
    p.add_argument("-sc", "--skip-cuts", action="store_true", help="count all pairs, without sampling")
    p.add_argument("-ic", "--item-cut", type=int, default=500, help="interactions sampled per item")
    p.add_argument("-uc", "--user-cut", type=int, default=500, help="interactions kept per user")
    p.add_argument("-k", "--top-k", type=int, default=10, help="partners per item")
    p.add_argument("-ws", "--window-size", type=int, required=True)
    p.add_argument("-wu", "--window-unit", default="MILLISECONDS", help=", ".join(UNITS))
    p.add_argument("-s", "--seed", type=parse_seed, default=None)
    p.add_argument("--recursive", action="store_true", help="read folders within the folder, too")
    p.add_argument("--modified-after", default=None, help="only files modified after this time, as 2024-01-31T00:00:00")
    p.add_argument("--interval", type=int, default=None, help="look for new files every so many ms instead of reading once")
    p.add_argument("-bt", "--buffer-timeout", type=int, default=100, help="accepted and ignored")
    return p


def from_args(args: list[str] | None = None) -> Config:
    found = {k: v for k, v in vars(parser().parse_args(args)).items() if v is not None}
    return Config(**found)


if __name__ == "__main__":
    print(from_args().describe())
