"""Quality classifier by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages of 64 words. Each passage is encoded, gated attention weighs the passages,

    h = tanh(x E + e),  s = w . (tanh(h V) * sigmoid(h U)),  a = softmax(s),  z = sum of a h,  score = sigmoid(z c + b),

and only the document's label trains all of it. A passage's input x holds shape measures of its words and a hashed
bag of its character trigrams, which know neither the label's table nor language, source or id.

Training: a bounded sample of labelled documents (MOST_TRAIN, a parameter) is read to the driver as packed counts of
every passage, from which the inputs of a step are worked out as they are for scoring, and fitted there by Adam.
Scoring: every passage of every whole text, in the map stage, with the fitted arrays (a fixed size, about 0.3 MB)
shipped to the executors; a long text's passages are weighed in runs, with a running softmax.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, StructField, StructType

from corvane.llm.common import map_batches, written

PASSAGE = 64
HASHED = 512
SHAPES = 12
WIDTH = SHAPES + HASHED
HIDDEN, GATE = 24, 12
#: Labelled documents that the fit reads at most.
MOST_TRAIN = 6000
EPOCHS, RATE, BAGS, SEED = 12, 0.01, 32, 7
#: Passages that are scored at once.
RUN = 2000

SYMBOLS = b"#*$%&|<>~^=+\\@{}[]_"
MARKS = b".,;:!?\"'()-"


def _byte_classes() -> np.ndarray:
    """For each byte: lower, upper, digit, symbol, mark, white space, other; one column a class."""
    out = np.zeros((256, 7), np.float64)
    for b in range(256):
        c = bytes([b])
        k = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in SYMBOLS else 4 if c in MARKS else 5 if c in b" \t\n\r\x0b\x0c" else 6
        out[b, k] = 1
    return out


CLASSES = _byte_classes().argmax(1)


def counted(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shape measures (float32) and trigram counts (uint16) of a text's passages, in runs; a text without words has one passage of zeros."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        yield np.zeros((1, SHAPES), np.float32), np.zeros((1, HASHED), np.uint16)
        return
    line = b" ".join(words)
    raw = np.frombuffer(line, np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = -(-n // PASSAGE)
    for first in range(0, count, RUN):
        last = min(count, first + RUN)
        shapes, grams_of = np.zeros((last - first, SHAPES), np.float32), np.zeros((last - first, HASHED), np.uint16)
        for row, k in enumerate(range(first, last)):
            a, b = k * PASSAGE, min(n, (k + 1) * PASSAGE)
            part = raw[starts[a] : ends[b - 1]]
            own = words[a:b]
            classes = np.bincount(CLASSES[part], minlength=7) / len(part)
            distinct = len(set(own)) / (b - a)
            pairs = len(set(zip(own, own[1:], strict=False))) / max(1, b - a - 1)
            tail = sum(not w[-1:].isalnum() and w[-1] < 128 for w in own) / (b - a)
            double = line.count(b"!!", starts[a], ends[b - 1]) / (b - a)
            shapes[row] = [*classes, lengths[a:b].mean() / 10, distinct, pairs, tail, double]
            if len(part) >= 3:
                low = part.astype(np.uint32)
                low = np.where((low >= 65) & (low <= 90), low + 32, low)
                grams = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
                at = (grams * np.uint32(2654435761)) >> np.uint32(23)
                # Words of megabytes fill a counter to its end.
                grams_of[row] = np.minimum(np.bincount(at, minlength=HASHED), 65535)
        yield shapes, grams_of


def inputs(shapes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Passage inputs, one row each: the shape measures, then the roots of the trigrams' shares."""
    share = counts / np.maximum(counts.sum(1, dtype=np.int64), 1)[:, None]
    return np.concatenate((shapes, np.sqrt(share).astype(np.float32)), axis=1)


def passages(text: str | None) -> np.ndarray:
    """Inputs of all of a text's passages."""
    return np.concatenate([inputs(*x) for x in counted(text)])


def packed(text: str | None) -> bytes:
    """All of a text's passages, as counted, compressed; unpacked() gives their inputs."""
    found = list(counted(text))
    whole = np.concatenate([x for x, _ in found]).tobytes() + np.concatenate([x for _, x in found]).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(whole)


def unpacked(data: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = len(data) // (4 * SHAPES + 2 * HASHED)
    return inputs(np.frombuffer(data, np.float32, n * SHAPES).reshape(n, SHAPES), np.frombuffer(data, np.uint16, n * HASHED, 4 * n * SHAPES).reshape(n, HASHED))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """The arrays of a fitted model; forward() scores bags of passages."""

    SHAPE = {"E": (WIDTH, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for k, s in self.SHAPE.items()}
        self.p["w"] = rng.normal(0, 0.3, GATE)
        self.p["c"] = rng.normal(0, 0.3, HIDDEN)

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> tuple:
        """bag: the bag of each row of x, ascending. Returns the bags' scores and what a gradient needs."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, s)
        a = np.exp(s - top[bag])
        a /= np.bincount(bag, a, bags)[bag]
        z = np.zeros((bags, HIDDEN))
        np.add.at(z, bag, a[:, None] * h)
        return _sigmoid(z @ p["c"] + p["b"][0]), (x, h, v, u, a, z)

    def gradient(self, y: np.ndarray, bag: np.ndarray, score: np.ndarray, kept: tuple) -> dict:
        p = self.p
        x, h, v, u, a, z = kept
        d = (score - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        ds = a * (da - np.bincount(bag, a * da, len(y))[bag])
        dv, du = ds[:, None] * p["w"] * u * (1 - v * v), ds[:, None] * p["w"] * v * u * (1 - u)
        dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h * h)
        return {"E": x.T @ dx, "e": dx.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": ((v * u) * ds[:, None]).sum(0), "c": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[bytes], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
        """Adam on the mean log loss with weight decay on E. bags: packed() texts, unpacked a step's at a time."""
        rng = np.random.default_rng(seed)
        n, total, squares = 0, np.zeros(WIDTH), np.zeros(WIDTH)
        for x in map(unpacked, bags):
            n += len(x)
            total += x.sum(0, dtype=np.float64)
            squares += np.square(x, dtype=np.float64).sum(0)
        self.mean, squares = total / n, squares / n
        self.scale = np.sqrt(np.maximum(squares - self.mean**2, 0)) + 1e-2
        y = y.astype(np.float64)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        turn = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BAGS):
                pick = order[at : at + BAGS]
                step = [unpacked(bags[i]) for i in pick]
                x = np.concatenate(step).astype(np.float64)
                bag = np.repeat(np.arange(len(pick)), list(map(len, step)))
                score, kept = self.forward(x, bag, len(pick))
                g = self.gradient(y[pick], bag, score, kept)
                g["E"] += 1e-3 * self.p["E"]
                turn += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    q[k] = 0.999 * q[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(q[k] / (1 - 0.999**turn)) + 1e-8)
        return self

    def score_long(self, runs: Iterator[np.ndarray]) -> float:
        """The score of one bag whose passages come in runs: attention's sums are carried from run to run."""
        top, weight, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in runs:
            _, (_, h, v, u, *_) = self.forward(x.astype(np.float64), np.zeros(len(x), np.int64), 1)
            s = (v * u) @ self.p["w"]
            high = max(top, s.max())
            a, old = np.exp(s - high), np.exp(top - high)
            top, weight, z = high, weight * old + a.sum(), z * old + a @ h
        return float(_sigmoid(z / weight @ self.p["c"] + self.p["b"][0]))

    def score(self, texts: list[str | None]) -> list[float]:
        """Scores of whole texts; passages are weighed in runs of texts, and long texts in runs of passages, to bound the memory."""
        out: list[float] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            if held:
                bag = np.repeat(np.arange(len(held)), [len(x) for x in held])
                out.extend(self.forward(np.concatenate(held).astype(np.float64), bag, len(held))[0].tolist())
                held.clear()

        for t in texts:
            if len(t or "") >= 2 * PASSAGE * RUN:
                flush()
                out.append(self.score_long(inputs(*x) for x in counted(t)))
                continue
            held.append(passages(t))
            if sum(map(len, held)) > RUN:
                flush()
        flush()
        return out


def held_out(id: int | None) -> bool:
    """Rows that the fit never sees: CRC-32 of the id as text is divisible by 5; a null id counts as empty text."""
    return zlib.crc32(b"" if id is None else str(id).encode()) % 5 == 0


def training_bags(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAIN, label: str = "quality") -> tuple[list[bytes], np.ndarray]:
    """Packed passages and labels of at most `most` labelled documents that aren't held out, the least by a hash of the id."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc % 5 != 0)).select("doc_id", F.col(label).cast("int").alias("_y"))
    chosen = usable.groupBy("doc_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = written(chosen, "chosen").withColumnRenamed("doc_id", "_id")
    # At most `most` rows of two numbers: a proven bound for the broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text")

    def run(ids: list, ys: list, texts: list) -> list:
        return [ids, ys, list(map(packed, texts))]

    schema = StructType([docs.schema["doc_id"], StructField("y", IntegerType()), StructField("x", BinaryType())])
    # One row an id, so that repeated rows don't lift the bound.
    once = map_batches(rows, run, schema, cut=500).groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    got = sorted(once.collect(), key=lambda r: r[0])
    return [bytes(r[2]) for r in got], np.array([r[1] for r in got])


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAIN, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Null and empty texts are bags of one empty passage and get the score that the model gives it; repeated rows get
    equal scores; without usable labels of both kinds every score is 0.5. Labels whose quality is neither 0 nor 1 and
    labels without a document are left out; of several labels of a document the larger counts.
    """
    bags, y = training_bags(docs, labels, most)
    model = Model().fit(bags, y) if len(set(y.tolist())) == 2 else None

    def run(ids: list, texts: list) -> list:
        scores = model.score(texts) if model else [0.5] * len(texts)
        return [ids, [held_out(i) for i in ids], scores, [int(s >= threshold) for s in scores]]

    schema = StructType([docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return map_batches(docs.select("doc_id", "text"), run, schema, cut=500)
