"""Grids of penalties and the rule that leaves out pairs which can only be emptier."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from .score import STATISTICS


def penalty_range(low: str, high: str, step: str, inclusive: bool = True) -> list[str]:
    """low, low + step, ... up to high, as exact decimals in text."""
    at, end, by = Decimal(low), Decimal(high), Decimal(step)
    if by <= 0:
        raise ValueError("the step must be positive")
    out = []
    while at < end or inclusive and at == end:
        out.append(format(at.normalize(), "f"))
        at += by
    return out


def penalty_grid(first: list[str], second: list[str]) -> list[tuple[str, str]]:
    """All pairs, the first penalty outermost."""
    return [(a, b) for a in first for b in second]


@dataclass
class Skip:
    """The rule of a sequential search over a grid, taken in grid order.

    A pair with at most min_groups groups sets the limit for later second penalties; above it pairs are left out; if its
    second penalty is the smallest so far, the search ends."""

    min_groups: int
    least: float = 1.0
    limit: float = 1.0
    ended: bool = False

    def may(self, l2: float) -> bool:
        return not self.ended and l2 <= self.limit

    def takes(self, l2: float, groups: int) -> tuple[bool, bool]:
        """Whether the search fits the pair, and whether it then has at most min_groups groups."""
        if self.ended:
            return False, False
        self.least = min(self.least, l2)
        if l2 > self.limit:
            return False, False
        below = groups <= self.min_groups
        if below and l2 == self.least:
            self.ended = True
        elif below:
            self.limit = l2
        return True, below


def kept_pairs(rows: list[tuple[int, float, float, int]], min_groups: int) -> list[tuple[int, bool]]:
    """grid_ord and below_min_groups of the pairs that a sequential search would fit. rows: grid_ord, l1, l2, nz_groups."""
    rule, out = Skip(min_groups), []
    for ord_, _, l2, groups in sorted(rows):
        fits, below = rule.takes(l2, groups)
        if fits:
            out.append((ord_, below))
    return out


@dataclass(frozen=True)
class Settings:
    """The parameters of a training run. subsets: parts for the screening, 0 for as many as two of them fit memory (bytes). pairs: penalties
    in place of single ones and grids."""

    l1: str = "0.1"
    l2: str = "0.1"
    l1_grid: tuple[str, str, str] | None = None
    l2_grid: tuple[str, str, str] | None = None
    min_groups: int = -1
    rmse_cutoff: float = 100.0
    accuracy_cutoff: float = 0.0
    summary_only: bool = False
    group_penalty: bool = True
    class_balance: str = "none"
    kfold: int = 1
    bit_count: int = 1
    drop_singletons: bool = False
    data_type: str = "universal"
    method: str = "logistic"
    stats: str = ""
    m_grid: tuple[int, int] | None = None
    gene_limit: int = 100
    gene_cutoff: float = 0.0
    species_limit: int = 100
    subsets: int | None = None
    memory: int = 4 << 30
    pairs: tuple[tuple[str, str], ...] | None = None
    seed: int = 0
    inclusive: bool = True
    solver_options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if set(self.stats) - set(STATISTICS):
            raise ValueError(f"stats are letters of {''.join(STATISTICS)}")
        if self.subsets is not None and self.subsets != 0 and self.subsets < 2:
            raise ValueError("there are at least two subsets, or 0 for as many as memory needs")

    def grid(self) -> list[tuple[str, str]]:
        if (self.l1_grid is None) != (self.l2_grid is None):
            raise ValueError("give both penalty grids or none")
        if self.pairs is not None:
            pairs = list(self.pairs)
        elif self.l1_grid is None:
            pairs = [(self.l1, self.l2)]
        else:
            pairs = penalty_grid(penalty_range(*self.l1_grid, self.inclusive), penalty_range(*self.l2_grid, self.inclusive))
        return pairs if self.group_penalty else [(a, "0") for a in dict.fromkeys(a for a, _ in pairs)]


def preset(with_tree: bool) -> Settings:
    """The preset for building one hypothesis thoroughly: a 9 x 9 grid, early end at 3 groups, all statistics, an M-grid."""
    steps = ("0.1", "1.0", "0.1")
    return Settings(l1_grid=steps, l2_grid=steps, min_groups=3, stats="PGHS", m_grid=(20, 30), summary_only=True, class_balance="phylo" if with_tree else "weighted", inclusive=False)
