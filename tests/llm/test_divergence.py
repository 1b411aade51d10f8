from __future__ import annotations

import random
from collections import Counter

import pytest

from corvane.llm import divergence


def wanted(rows: list) -> list:
    """The audit of rows (doc_id, text, lang, source) in plain Python: every kept term of every pair."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        often = Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in often.items() if n >= 10)
        counts = {s: Counter() for _, s, _ in mine}
        for _, s, terms in mine:
            counts[s].update(t for t in terms if often[t] >= 10)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        shares, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s, p in shares.items():
            pairs = [(-sum(f(p[t], o[t]) for t in kept), u.encode()) for u, o in shares.items() if u != s]
            terms = [(-f(p[t], q[t]), t.encode()) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def corpus(seed: int, n: int, sources: int) -> list:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang, source = rng.choice(("en", "de", None)), rng.choice([*(f"s{k}" for k in range(sources)), None, ""])
        pool = 12 + 3 * (len(source or "") + sources)
        words = [rng.choice(("Wort", "über", "the", "中文"))] + [f"w{chr(97 + rng.randrange(pool) % 26)}{'x' * (rng.randrange(pool) // 6)}" for _ in range(rng.randrange(0, 30))]
        out.append((i, rng.choice([" ".join(words), " 9-".join(words), "", None]), lang, source))
    return out


@pytest.mark.parametrize(("heavy", "most", "tile", "terms"), [(3, 512, 64, 256), (0, 512, 64, 256), (1, 0, 64, 256), (1, 0, 3, 2), (2, 512, 2, 5)])
def test_audit_equals_brute_force_however_terms_are_split(make, monkeypatch, heavy, most, tile, terms):
    for name, value in (("HEAVY_SHARE", heavy), ("MOST_LIGHT", most), ("TILE", tile), ("TERMS", terms), ("CELLS", 50), ("HELD", 40)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(4, 260, 7)
    assert sorted(tuple(r) for r in divergence.divergence_table(make(rows)).collect()) == wanted(rows)


def test_languages_without_kept_terms(make):
    rows = [(0, "a b", "xx", "s"), (1, "c", "xx", "t"), (2, None, "xx", None), (3, "z", "yy", "s")]
    got = sorted(tuple(r) for r in divergence.divergence_table(make(rows)).collect())
    assert got == wanted(rows) and {r[4] for r in got} == {0} and len(got) == 6


def test_terms():
    assert divergence.terms_of("Ab-c9É\x80x\x7f中_Z") == [b"ab", b"c", "É\x80x".encode(), "中".encode(), b"z"]
    assert divergence.terms_of(None) == [] == divergence.terms_of(" 12 ")


def test_awkward_and_empty_tables(awkward, empty):
    from pyspark.sql import functions as F

    many = awkward
    for _ in range(4):
        many = many.union(many)
    rows = [tuple(r) for r in many.select("doc_id", "text", F.col("lang"), "source").collect()]
    assert sorted(tuple(r) for r in divergence.divergence_table(many).collect()) == wanted(rows)
    assert divergence.divergence_table(empty).collect() == []
