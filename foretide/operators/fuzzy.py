"""Edit-based similarity: insertion-deletion ratio, best partial alignment, insert-only edits."""

from __future__ import annotations

import re


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & at.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 x (1 - insertions and deletions / total length)."""
    return 100.0 * 2 * subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_alignment(needle: str, text: str, least: float = 0.0) -> tuple[float, int, int] | None:
    """(score, start, end) of the window of ``text``, as long as the needle or cut at an end, of highest ratio, the first
    of equals; None below ``least``. Windows have to begin or end with a character of the needle."""
    n, m = len(needle), len(text)
    if not n or not m:
        return None
    if n > m:
        found = ratio(needle, text)
        return (found, 0, m) if found >= least else None
    own, best = set(needle), (-1.0, 0, 0)
    for start in range(1 - n, m):
        a, b = max(start, 0), min(start + n, m)
        if text[a] not in own and text[b - 1] not in own:
            continue
        if 200 * min(n, b - a) / (n + b - a) <= best[0]:
            continue
        score = ratio(needle, text[a:b])
        if score > best[0]:
            best = (score, a, b)
            if score == 100:
                break
    return best if best[0] >= least else None


def only_grows(a: str, b: str) -> bool:
    """One name is the other with characters added: the shorter is a subsequence of the longer."""
    short, long_ = sorted((a, b), key=len)
    rest = iter(long_)
    return all(c in rest for c in short)


NAME_NOISE = re.compile(r"[\s()\[\]{}·ㆍ,.\-_/]")
