"""Every constant of the engine, by result family."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RankConfig:
    k1: float = 1.5
    b: float = 0.75
    candidates: int = 50
    rrf_k: int = 60
    max_rewrites: int = 3
    rewrite_weight: float = 0.25
    rewrite_jaccard: float = 0.15
    blend: float = 0.65
    adopt_margin: float = 0.15
    relaxed_margin: float = 0.10
    low_confidence: float = 0.08
    skip_margin: float = 0.10
    skip_enabled: bool = True
    scope_bonus: float = 0.08
    scope_penalty: float = 0.06
    scope_bias: bool = True
    drop_textless: bool = False
    top_k: int = 10


@dataclass(frozen=True)
class WindowConfig:
    gate_top: int = 1
    gate_low_two: float = 0.08
    gate_low_three: float = 0.04
    gate_max: int = 3
    primary_first_margin: float = 0.06
    cap: int = 24
    clauses_per_control: int = 12
    clause_pool: int = 72
    rescue_max: int = 4
    fallback_checked: int = 25
    closure_children: int = 16
    closure_total: int = 64
    closure_levels: int = 2


RANK = RankConfig()
#: The recorded notebook study: no scope bias, one adoption threshold, textless controls leave.
NOTEBOOK = replace(RANK, scope_bias=False, drop_textless=True, relaxed_margin=RANK.adopt_margin)
WINDOW = WindowConfig()
ASSIGNMENT_SENTINEL = "__ASSIGNMENT_REQUIRED__"
Z_95 = 1.959963984540054


#: Conditions of the sensitivity grid (fixed values): each moves one constant of the gates by a fifth.
CONDITIONS = {
    "baseline": RANK,
    "alpha_minus20": replace(RANK, blend=0.52),
    "alpha_plus20": replace(RANK, blend=0.78),
    "adoption_minus20": replace(RANK, adopt_margin=0.12),
    "adoption_plus20": replace(RANK, adopt_margin=0.18),
    "skip_minus20": replace(RANK, skip_margin=0.08),
    "skip_plus20": replace(RANK, skip_margin=0.12),
}
