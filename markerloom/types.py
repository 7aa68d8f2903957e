"""Enumerations, group resolution and errors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

import numpy as np

MAX_DEPTH = 65535


class MarkerError(ValueError):
    """An input or a parameter that can't be used."""


class Test(Enum):
    """Tests of association of a marker with one of two groups."""

    __test__ = False  # not a test case
    CHISQ = ("chisq", "chi-squared", "chi2")
    FISHER = ("fisher", "fisher-exact")
    GTEST = ("gtest", "g-test", "g")

    @classmethod
    def of(cls, name: str | Test) -> Test:
        return _named(cls, name, "test")


class Correction(Enum):
    """Corrections for the number of markers tested."""

    BONFERRONI = ("bonferroni", "bonf")
    FDR = ("fdr", "bh", "benjamini-hochberg")
    NONE = ("none", "disabled")

    @classmethod
    def of(cls, name: str | Correction) -> Correction:
        return _named(cls, name, "correction")


def _named(kind, name, what):
    if isinstance(name, kind):
        return name
    for x in kind:
        if str(name).lower() in x.value:
            return x
    raise MarkerError(f"unknown {what} {name!r}")


@dataclass(frozen=True)
class Groups:
    """The two groups compared, in order, with their sizes in the population map."""

    group1: str
    group2: str
    total1: int
    total2: int


def resolve_groups(popmap: Sequence[tuple[str, str]], group1: str | None = None, group2: str | None = None) -> Groups:
    """Name both groups, or neither where the population map has exactly two (the first seen is group 1)."""
    seen: dict[str, int] = {}
    names = set()
    for individual, group in popmap:
        if individual in names:
            raise MarkerError(f"individual {individual!r} is in the population map twice")
        names.add(individual)
        seen[group] = seen.get(group, 0) + 1
    if (group1 is None) != (group2 is None):
        raise MarkerError("name both groups or neither")
    if group1 is None:
        if len(seen) != 2:
            raise MarkerError(f"{len(seen)} groups in the population map; name the two to compare")
        group1, group2 = seen
    for g in (group1, group2):
        if g not in seen:
            raise MarkerError(f"group {g!r} isn't in the population map")
    if group1 == group2:
        raise MarkerError("the two groups are the same")
    return Groups(group1, group2, seen[group1], seen[group2])


def single(x: float) -> float:
    """A threshold in single precision, widened again."""
    return float(np.float32(x))


def least_individuals(frequency: float, n: int) -> int:
    """The whole part of ``frequency * n`` in single precision."""
    return int(np.float32(frequency) * np.float32(n))
