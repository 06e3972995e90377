"""Validated mining parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

ALL, MAXIMAL, CLOSED = "all", "maximal", "closed"
LEVELWISE, PIVOT = "levelwise", "pivot"
_TYPES = {"a": ALL, "m": MAXIMAL, "c": CLOSED}


def pattern_type(value: str | None) -> str:
    """By the first letter, as on the command line; anything else means all patterns."""
    return _TYPES.get((value or "a")[:1].lower(), ALL)


@dataclass(frozen=True)
class MiningParams:
    """sigma: least number of sequences; gamma: most positions between neighbours; lam: greatest length.

    ``partition_size`` is the document-frequency budget of a pivot partition, ``strategy`` how support is counted
    (the result doesn't depend on it), ``per_file`` mines each input file by itself, ``indexing`` and ``split`` are
    accepted for compatibility and change nothing: the optimizer decides what they used to.
    """

    sigma: int = 1
    gamma: int = 0
    lam: int = 5
    type: str = ALL
    strategy: str = LEVELWISE
    partition_size: int = 10_000
    num_reducers: int | None = None
    per_file: bool = False
    indexing: str = "none"
    split: bool = False

    def __post_init__(self) -> None:
        for name, least in (("sigma", 1), ("gamma", 0), ("lam", 2), ("partition_size", 1)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < least:
                raise ValueError(f"{name} must be an integer of at least {least}, not {value!r}")
        if self.type not in _TYPES.values():
            raise ValueError(f"type must be one of {sorted(_TYPES.values())}, not {self.type!r}")
        if self.strategy not in (LEVELWISE, PIVOT):
            raise ValueError(f"strategy must be {LEVELWISE!r} or {PIVOT!r}, not {self.strategy!r}")
        if self.num_reducers is not None and self.num_reducers < 1:
            raise ValueError("num_reducers must be at least 1")

    def but(self, **changes: Any) -> MiningParams:
        return replace(self, **changes)
