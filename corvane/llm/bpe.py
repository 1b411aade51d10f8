"""Byte-level BPE by a segment tree over the byte positions of each pre-token.

A leaf holds the rank of the pair that begins at its byte, an inner node the lesser of its children, the left one at a
tie. The root thus names the leftmost pair of the least rank. A merge takes one byte position out of the list of live
ones and sets three leaves: the pair it began, the pair before it and the one it swallowed. That is logarithmic in the
pre-token's length, so a run of a hundred thousand letters takes as long a letter as a word does.

Short pre-tokens are encoded many at once: the same trees, one a row of an array, with the leaves and inner nodes of all
rows updated together. Equal pre-tokens are encoded once for each worker: a bounded dictionary keeps their ids.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corvane.llm.common import map_batches

#: Pre-tokens kept by a worker; beyond it the dictionary starts anew.
CACHE = 250_000
#: Longer pre-tokens aren't kept, so that the dictionary's memory is bounded, and are encoded one by one.
CACHE_BYTES = 64
#: Pre-tokens whose trees are updated together.
TOGETHER = 8_000
NONE = 1 << 40


class Encoder:
    """Encodes and decodes by the ranks of a file of lines `base64(bytes) rank`; pattern cuts texts into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, tuple[str, int, bytes]] = {}
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = [(a << 32 | b, rank) for token, rank in self.ranks.items() for a, b in self._halves(token)]
        self._fill(np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64))
        two = self.byte_ids << 32
        self.byte_pairs = self._found((two[:, None] | np.maximum(self.byte_ids, 0)[None, :]).ravel())

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """A hash table of pairs of ids: open addressing, places tried one after another, at most self.tries of them."""
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slot_keys, self.slot_ranks, self.tries = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64), 1
        slots = self._slot(keys)
        while len(keys):
            free = self.slot_keys[slots] < 0
            _, first = np.unique(slots, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.slot_keys[slots[put]], self.slot_ranks[slots[put]] = keys[put], ranks[put]
            keys, ranks, slots = keys[~put], ranks[~put], (slots[~put] + 1) & ((1 << self.bits) - 1)
            self.tries += bool(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where they make up no token."""
        slots = self._slot(keys)
        there = self.slot_keys[slots]
        out = np.where(there == keys, self.slot_ranks[slots], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        for _ in range(self.tries - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            there = self.slot_keys[slots[open_]]
            out[open_] = np.where(there == keys[open_], self.slot_ranks[slots[open_]], -1)
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return out

    def _halves(self, token: bytes) -> list[tuple[int, int]]:
        """Ids of every two tokens that make up a token."""
        get = self.ranks.get
        found = ((get(token[:k]), get(token[k:])) for k in range(1, len(token)))
        return [(a, b) for a, b in found if a is not None and b is not None]

    def pair_leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of the pairs of ids a, b (below 0: none) that begin at places at: rank and place, or NONE."""
        rank = np.where((a >= 0) & (b >= 0), self._found(np.maximum(a, 0) << 32 | np.maximum(b, 0)), -1)
        return np.where(rank >= 0, rank << 8 | at, NONE)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """merge() of pre-tokens of at most CACHE_BYTES bytes that are no tokens themselves, all at once."""
        rows = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, rows)
        size = 1 << int(n.max() - 1).bit_length()
        ids = np.full((rows, size + 1), -1, np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        inside = np.arange(size + 1) < n[:, None]
        ids[inside] = self.byte_ids[raw]
        after = np.tile(np.arange(1, size + 2), (rows, 1))
        before = after - 2
        tree = np.full((rows, 2 * size), NONE, np.int64)
        # The first leaves, two bytes each, come from a table of all pairs of bytes; a piece's last byte begins none.
        pairs = np.append(self.byte_pairs[raw[:-1].astype(np.int64) << 8 | raw[1:]], -1)
        pairs[np.cumsum(n) - 1] = -1
        tree[:, size:][inside[:, :-1]] = np.where(pairs >= 0, pairs << 8 | np.nonzero(inside)[1], NONE)
        level = size >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        # From here on all arrays are flat; a live row is known by where it begins in each of them.
        wide = size + 1
        ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.arange(rows)
        while True:
            top = tree[live * (2 * size) + 1]
            more = top < NONE
            live, top = live[more], top[more]
            if not len(live):
                break
            at, root = live * wide, live * (2 * size)
            i, rank = top & 255, top >> 8
            j = after[at + i]
            nxt = after[at + j]
            back = before[at + i]
            ids[at + i], ids[at + j], after[at + i] = rank, -1, nxt
            before[at + np.minimum(nxt, size)] = i
            # Places past the end have id -1, so no pair with them has a rank; so has place -1, which stands for i itself.
            led = np.where(back >= 0, back, i)
            both = np.concatenate((i, led))
            left = np.concatenate((rank, ids[at + led]))
            right = np.concatenate((ids[at + np.minimum(nxt, size)], np.where(back >= 0, rank, -1)))
            leaves = self.pair_leaves(left, right, both)
            tree[root + size + j] = NONE
            tree[np.concatenate((root, root)) + size + both] = leaves
            lone = back < 0
            tree[root[lone] + size + i[lone]] = leaves[: len(i)][lone]
            root, node = np.concatenate((root, root, root)), np.concatenate((j, both)) + size
            for _ in range(size.bit_length() - 1):
                node >>= 1
                under = root + 2 * node
                tree[root + node] = np.minimum(tree[under], tree[under + 1])
        ids = ids.reshape(rows, wide)
        left = ids >= 0
        flat = iter(ids[left].tolist())
        return [[next(flat) for _ in range(k)] for k in left.sum(1).tolist()]

    def learn(self, pieces: set[str]) -> None:
        """Encodes the short ones of pieces into the dictionary together."""
        if len(self.kept) + len(pieces) > CACHE:
            self.kept.clear()
        new = [(p, p.encode()) for p in pieces if p not in self.kept]
        tokens = [(p, [self.ranks[raw]], raw) for p, raw in new if raw in self.ranks]
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for p, raw in new:
            if raw not in self.ranks and len(raw) <= CACHE_BYTES:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for group in groups.values():
            for at in range(0, len(group), TOGETHER):
                part = group[at : at + TOGETHER]
                tokens += [(p, ids, raw) for (p, raw), ids in zip(part, self.merge_many([raw for _, raw in part]), strict=True)]
        for p, ids, _ in tokens:
            self.kept[p] = (",".join(map(str, ids)), len(ids), self.decode(ids))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        # tree[size + i]: the rank of the pair that begins at byte i and i itself in one number, so the least is leftmost.
        shift = n.bit_length() + 1
        mask = (1 << shift) - 1
        tree = [NONE << shift] * (2 * size)
        after = list(range(1, n + 1))  # the live position that follows a live one
        before = list(range(-1, n - 1))
        get = ranks.get
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << shift | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b

        def put(i: int) -> None:
            """Sets the leaf of the pair that begins at live position i."""
            j = after[i]
            rank = get(piece[i : after[j]]) if j < n else None
            k = size + i
            tree[k] = NONE << shift if rank is None else rank << shift | i
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a <= b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (top := tree[1]) >> shift != NONE:
            i = top & mask
            j = after[i]
            nxt = after[j]
            after[i] = nxt
            if nxt < n:
                before[nxt] = i
            after[j] = n  # position j is no longer live: no pair begins there
            put(j)
            put(i)
            if before[i] >= 0:
                put(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def known(self, piece: str) -> tuple[str, int, bytes]:
        """A pre-token's ids as text, how many they are, and the bytes that they decode to."""
        got = self.kept.get(piece)
        if got is None:
            raw = piece.encode()
            ids = self.merge(raw)
            got = (",".join(map(str, ids)), len(ids), self.decode(ids))
            if len(raw) <= CACHE_BYTES:
                if len(self.kept) >= CACHE:
                    self.kept.clear()
                self.kept[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        return self.joined(self.split(text or ""))

    def joined(self, pieces: list[str]) -> list[int]:
        """The ids of a text's pre-tokens."""
        kept = self.kept
        return list(map(int, ",".join([(kept.get(p) or self.known(p))[0] for p in pieces]).split(","))) if pieces else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path, pattern)


def token_digests(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of every row; null counts as empty.

    An empty text has no ids, and both digests are those of nothing. No shuffle; repeated rows give repeated results.
    The vocabulary's file must be found at path on every executor.
    """

    def run(ids: list, texts: list) -> list:
        e = encoder(path, pattern)
        out: list[tuple[int, str, str]] = []
        cut = [e.split(t or "") for t in texts]
        e.learn(set().union(*cut))
        kept = e.kept
        for pieces in cut:
            found = [kept.get(p) or e.known(p) for p in pieces]
            named = hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest()
            out.append((sum([x[1] for x in found]), named, hashlib.sha256(b"".join([x[2] for x in found])).hexdigest()))
        return [ids, *([x[k] for x in out] for k in range(3))]

    schema = StructType([docs.schema[id], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return map_batches(docs.select(id, text), run, schema, cut=500)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """The columns of keep, n_tokens and tokens (array of ids) of every row; null counts as empty.

    A mix repeats documents, one row after another: equal texts of a batch are cut and encoded once.
    """

    def run(*columns: list) -> list:
        e = encoder(path, pattern)
        cut = {t: e.split(t or "") for t in dict.fromkeys(columns[-1])}
        e.learn(set().union(*cut.values()))
        found = {t: e.joined(pieces) for t, pieces in cut.items()}
        tokens = [found[t] for t in columns[-1]]
        return [*columns[:-1], [len(x) for x in tokens], tokens]

    schema = StructType([*(docs.schema[k] for k in keep), StructField("n_tokens", LongType()), StructField("tokens", ArrayType(IntegerType(), False))])
    return map_batches(docs.select(*keep, text), run, schema, cut=500)
