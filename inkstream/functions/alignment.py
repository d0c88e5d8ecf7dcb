"""How much of two texts lies in the blocks that difflib aligns, without its cost on long texts."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np

#: Stretches in which at most so many equal characters meet are left to difflib.
PLAIN_MEETINGS = 1 << 15


def _levels(left: str, right: str) -> tuple[list[np.ndarray], int]:
    """Numbers of the substrings of length 1, 2, 4, ... at every place of left, a separator and right: equal ones are equal.

    Ends with the last length at which the two have a substring in common.
    """
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (left, right))
    joined = np.concatenate([a, [1 << 32], b])
    _, ranks = np.unique(joined, return_inverse=True)
    levels, offset, width = [], len(a) + 1, 1
    while len(ranks) > offset and np.isin(ranks[: len(a) - width + 1], ranks[offset:]).any():
        levels.append(ranks.astype(np.int32))
        keys = ranks[:-width] * (int(ranks.max()) + 1) + ranks[width:]
        width *= 2
        if width > min(len(a), len(b)):
            break
        _, ranks = np.unique(keys, return_inverse=True)
    return levels, offset


def _keys(levels: list[np.ndarray], begin: int, end: int, width: int) -> np.ndarray:
    """Equal numbers for equal substrings of `width` that lie between begin and end."""
    level = levels[width.bit_length() - 1]
    step = 1 << (width.bit_length() - 1)
    first = level[begin : end - width + 1].astype(np.int64)
    return first * len(level) * 2 + level[begin + width - step : end - step + 1]


def _longest(levels: list[np.ndarray], offset: int, a_from: int, a_to: int, b_from: int, b_to: int) -> tuple[int, int, int]:
    """(place in left, place in right, length) of the longest common stretch: the first in left, then in right, if several are."""

    def shared(width: int) -> bool:
        return bool(np.isin(_keys(levels, a_from, a_to, width), _keys(levels, offset + b_from, offset + b_to, width)).any())

    low, high = 0, min(a_to - a_from, b_to - b_from, (1 << len(levels)) - 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shared(middle) else (low, middle - 1)
    if not low:
        return a_from, b_from, 0
    ours, theirs = _keys(levels, a_from, a_to, low), _keys(levels, offset + b_from, offset + b_to, low)
    i = int(np.isin(ours, theirs).argmax())
    return a_from + i, b_from + int((theirs == ours[i]).argmax()), low


def similarity(left: str, right: str, least: float = 0.0) -> float:
    """SequenceMatcher(None, left, right, autojunk=False).ratio(), or 0 where that stays below `least`.

    Long stretches are aligned by the numbers of their substrings, so a step takes time and memory in proportion to the
    texts (times a logarithm), not to their product. What can't reach `least` any more is given up.
    """
    if left == right:
        return 1.0
    total = len(left) + len(right)
    # Both bounds lie above the ratio, so a pair they rule out needs no alignment.
    if 2.0 * min(len(left), len(right)) / total < least or 2.0 * (Counter(left) & Counter(right)).total() / total < least:
        return 0.0
    levels, offset = None, 0
    matched, open_ = 0, min(len(left), len(right))
    waiting = [(0, len(left), 0, len(right))]
    while waiting:
        a_from, a_to, b_from, b_to = waiting.pop()
        open_ -= min(a_to - a_from, b_to - b_from)
        mine, other = Counter(left[a_from:a_to]), Counter(right[b_from:b_to])
        if sum(n * other[c] for c, n in mine.items()) <= PLAIN_MEETINGS:
            matched += sum(m.size for m in SequenceMatcher(None, left[a_from:a_to], right[b_from:b_to], autojunk=False).get_matching_blocks())
        else:
            if levels is None:
                levels, offset = _levels(left, right)
            i, j, size = _longest(levels, offset, a_from, a_to, b_from, b_to)
            matched += size
            for part in ((a_from, i, b_from, j), (i + size, a_to, j + size, b_to)):
                if size and part[0] < part[1] and part[2] < part[3]:
                    waiting.append(part)
                    open_ += min(part[1] - part[0], part[3] - part[2])
        if 2.0 * (matched + open_) / total < least:
            return 0.0
    return 2.0 * matched / total
