"""Deterministic random trees and ensembles for tests and benchmarks."""

from __future__ import annotations

import random


def balanced(names: list[str], rng: random.Random, step: float = 0.25) -> str:
    """A balanced tree over shuffled names; lengths are multiples of ``step``."""
    parts = [f"{x}:{step * rng.randint(1, 8)}" for x in rng.sample(names, len(names))]
    while len(parts) > 2:
        joined = [f"({a},{b}):{step * rng.randint(1, 8)}" for a, b in zip(parts[::2], parts[1::2])]
        parts = joined + ([parts[-1]] if len(parts) % 2 else [])
    return "(" + ",".join(parts) + ");"


def caterpillar(names: list[str], rng: random.Random, step: float = 0.25) -> str:
    """A ladder over shuffled names."""
    names = rng.sample(names, len(names))
    text = names[0]
    for x in names[1:]:
        text = f"({text}:{step * rng.randint(1, 8)},{x}:{step * rng.randint(1, 8)})"
    return text + ";"


def bushy(names: list[str], rng: random.Random, step: float = 0.25) -> str:
    """A tree with nodes of two to five children, some inner lengths zero."""

    def build(part: list[str]) -> str:
        if len(part) == 1:
            return part[0]
        k = min(len(part), rng.randint(2, 5))
        cuts = sorted(rng.sample(range(1, len(part)), k - 1))
        kids = [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]
        return "(" + ",".join(f"{build(x)}:{step * rng.randint(0 if len(x) > 1 else 1, 6)}" for x in kids) + ")"

    return build(rng.sample(names, len(names))) + ";"


def ensemble(n_trees: int, names: list[str], seed: int, kinds=(balanced, caterpillar, bushy), least: int = 4) -> list[str]:
    """Trees of all kinds by turns, each over a random part of the names."""
    rng = random.Random(seed)
    return [kinds[i % len(kinds)](rng.sample(names, rng.randint(least, len(names))), rng) for i in range(n_trees)]
