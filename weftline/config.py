"""Parameters of a search run."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product


@dataclass(frozen=True)
class SearchConfig:
    """``window`` None is "full": the search length. ``topk_mode`` "le" counts ranks up to ``top_k``; "reference" counts
    ranks from ``top_k`` on. ``threshold_unit`` "fraction" compares fractions; "reference" compares percentages with
    the same numbers. ``cluster_mode`` is "islands" or "greedy"."""

    long_adjust: float = 1.0
    short_adjust: float = 1.3
    short_length: int = 20
    window: int | None = None
    top_n: int = 500
    top_k: int = 5
    full: float = 0.9
    partial: float = 0.5
    metric: str = "cosine"
    method: str = "char"
    topk_mode: str = "le"
    threshold_unit: str = "fraction"
    cluster_mode: str = "islands"
    leave_out: tuple[int, ...] = field(default_factory=tuple)

    def search_length(self, n: int) -> int:
        return int(n * (1 + (self.long_adjust if n > self.short_length else self.short_adjust)))

    def results_dir(self, name: str) -> str:
        window = "full" if self.window is None else self.window
        return f"{name}_{window}_{int(self.short_adjust * 100)}_{self.short_length}_{int(self.long_adjust * 100)}_{self.top_n}_{self.method}"


def grid(**choices: list) -> list[SearchConfig]:
    """Every combination of the given parameter values."""
    return [SearchConfig(**dict(zip(choices, values))) for values in product(*choices.values())]
