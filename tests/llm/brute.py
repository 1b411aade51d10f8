"""Brute-force versions that tests of this folder share."""

from __future__ import annotations


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    """Every run of w by comparing all words a period apart; of equal stretches the least period."""
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if (length := j - i + p) >= max(6, 4 * p) and j > i:
                out.setdefault((i, length), p)
            i = max(j, i + 1)
    return sorted((s, m, p) for (s, m), p in out.items())


def shingles(text: str | None, words: int) -> frozenset:
    found = (text or "").encode().lower().split()
    if not found:
        return frozenset()
    return frozenset(b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def components(n: int, links: set) -> list[int]:
    """The least node of each node's component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
