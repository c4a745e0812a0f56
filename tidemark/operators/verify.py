"""Checks of a run's figures against expected ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Check:
    """``kind``: exact, approx (absolute), approx_rel (relative to the expected), exists, or filelist (all expected names are found); ``level``: fail or warn."""

    name: str
    kind: str
    get: Callable[[], object]
    tolerance: float = 0.0
    level: str = "fail"

    def agrees(self, expected: object, found: object) -> bool:
        if self.kind == "exists":
            return bool(found)
        if self.kind == "filelist":
            return set(expected or ()) <= set(found or ())
        if self.kind == "exact":
            return found == expected
        if not isinstance(expected, (int, float)) or not isinstance(found, (int, float)):
            return False
        room = self.tolerance * (abs(expected) if self.kind == "approx_rel" else 1)
        return abs(found - expected) <= room + 1e-12


def verify(checks: list[Check], expected: Mapping[str, object]) -> dict[str, str]:
    """``PASS``, ``WARN``, ``FAIL`` or ``MISSING`` for every check; what raises fails."""
    out = {}
    for check in checks:
        if check.kind != "exists" and check.name not in expected:
            out[check.name] = "MISSING"
            continue
        try:
            good = check.agrees(expected.get(check.name), check.get())
        except Exception:
            good = False
        out[check.name] = "PASS" if good else check.level.upper()
    return out


def snapshot(checks: list[Check]) -> dict[str, object]:
    """The figures found, to be stored as the expected ones."""
    return {c.name: c.get() for c in checks if c.kind != "exists"}
