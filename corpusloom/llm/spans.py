"""Spans of texts: (start, kind, end, ...)."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate


def clear_of(taken: list[tuple], found: list[tuple]) -> list[tuple]:
    """The found spans (start, kind, end, ...) that no taken span overlaps; taken is sorted."""
    if not taken:
        return list(found)
    starts, ends = [t[0] for t in taken], list(accumulate((t[2] for t in taken), max))
    return [s for s in found if not (i := bisect_left(starts, s[2])) or ends[i - 1] <= s[0]]
