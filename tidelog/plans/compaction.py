"""When to merge which runs, and when tombstones may go."""

from __future__ import annotations

from .manifest import Run

#: Runs at a level from which on they are merged into the next; those of the bottom become one of the bottom.
FANOUT = {0: 4, 1: 4, 2: 4}
BOTTOM = 2


def below(level: int) -> int:
    """The level that a merge of ``level`` goes to."""
    return min(level + 1, BOTTOM)


def due(runs: list[Run]) -> int | None:
    """The lowest level with enough runs, none if no merge is due."""
    for level, most in FANOUT.items():
        if sum(r.level == level for r in runs) >= most:
            return level
    return None


def overlaps(a: Run, b: Run) -> bool:
    if None in (a.min_key, a.max_key, b.min_key, b.max_key):
        return False
    return a.min_key <= b.max_key and b.min_key <= a.max_key


def tombstones_may_go(inputs: list[Run], live: list[Run]) -> bool:
    """True if no run outside ``inputs`` can hold an older version of a key that an input deletes: none that has
    an operation before the inputs' last one and meets their key range. Otherwise a deleted key could come
    back."""
    paths, last = {r.path for r in inputs}, max((r.max_seq for r in inputs), default=-1)
    return not any(
        r.path not in paths and r.min_seq <= last and any(overlaps(r, i) for i in inputs) for r in live
    )


def prune(runs: list[Run], start: bytes = b"", end: bytes | None = None, key: bytes | None = None) -> list[Run]:
    """Runs whose key range meets a point or a half-open range; decided from the manifest alone."""
    def meets(r: Run) -> bool:
        if r.min_key is None or r.max_key is None:
            return False
        if key is not None:
            return r.min_key <= key <= r.max_key
        return r.max_key >= start and (not end or r.min_key < end)

    return [r for r in runs if meets(r)]
