"""Weighted string similarity, 0 to 100, after the published definitions of the indel ratio family."""

from __future__ import annotations


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer, cut off at its ends."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a

    def best(x: str, y: str) -> float:
        n = len(x)
        windows = {y[max(0, i) : i + n] for i in range(1 - n, len(y))}
        return max(ratio(x, w) for w in windows)

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


def _tokens(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), sorted(x - y), sorted(y - x)


def token_ratio(a: str, b: str) -> float:
    by_sort = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    both, left, right = _tokens(a, b)
    if both and (not left or not right):
        return 100.0
    common, x, y = " ".join(both), " ".join(both + left), " ".join(both + right)
    by_set = [ratio(x, y)] + ([ratio(common, x), ratio(common, y)] if both else [])
    return max(by_sort, *by_set)


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _tokens(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(left), " ".join(right)))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    whole, lengths = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if lengths < 1.5:
        return max(whole, 0.95 * token_ratio(a, b))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))
