"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence is a linear score of its own features and those of its two
neighbours; a 2 x 2 table weighs the step from one line's label to the next. Forward-backward
gives the probability of each line being good, and a document's score is their mean weighted by line length.

The field is fitted by gradient ascent on the conditional likelihood of the labelled documents, whose
lines all carry the document's label: steps between labels then become expensive, and a document's
lines decide together. The fit uses at most ``max_fit_docs`` labelled documents, those with the
smallest hashes of their ids, so its memory is bounded; everything is scored, whole.

Null and empty texts have no lines and get the share of good documents in the fit as their score. Without labels
every score is 0.5. A label for which the id occurs in several rows counts for each of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.common import Batches, batch_of, delete_path, id_type, keyed_text, raw_texts, written

FEATURES = (
    "upper", "digit", "mark", "odd_mark", "pipe", "stop", "words", "word_size", "repeat", "same_next", "shout", "short",
)
N = len(FEATURES)
#: Weights per feature for the line, the one before and the one after, and a constant.
WIDTH = 3 * N + 1
SENTENCE_MARKS = b".,;:?'\"()-"


def byte_classes() -> np.ndarray:
    """One row per counted class, over all byte values."""
    table = np.zeros((6, 256), bool)
    table[0, 65:91] = True
    table[1, 48:58] = True
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[2, marks] = True
    table[3, [b for b in marks if b not in SENTENCE_MARKS]] = True
    table[4, ord("|")] = True
    table[5, list(b".!?")] = True
    return table


CLASSES = byte_classes()


def line_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and lengths of the lines that hold anything but white space."""
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    if not lines:
        return np.zeros((0, N), np.float32), np.zeros(0)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(lines), np.uint8)
    shares = np.empty((6, len(lines)))
    for i, table in enumerate(CLASSES):
        shares[i] = np.add.reduceat(table[data].astype(np.int32), starts)
    shares /= sizes
    words = [line.split() for line in lines]
    count = np.fromiter(map(len, words), np.int64, len(words))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    same = np.fromiter((sum(map(bytes.__eq__, w, w[1:])) for w in words), np.int64, len(words))
    shout = np.fromiter((sum(w[-2:] == b"!!" for w in ws[:8]) for ws in words), np.int64, len(words))
    columns = [
        *np.minimum(shares[:5] * [[1], [4], [3], [4], [8]], 1.0),
        np.minimum(shares[5] * 20, 1.0),
        np.minimum(count / 40, 1.0),
        np.minimum(sizes / count / 20, 1.0),
        1 - distinct / count,
        same / count,
        np.minimum(shout / 3, 1.0),
        count < 4,
    ]
    return np.stack(columns, axis=1).astype(np.float32), sizes.astype(float)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Rows of own, previous and next features, and 1."""
    pad = np.zeros((1, N), x.dtype)
    return np.concatenate([x, np.concatenate([pad, x[:-1]]), np.concatenate([x[1:], pad]), np.ones((len(x), 1), x.dtype)], 1)


@dataclass(frozen=True)
class Field:
    """Weights of the good label's evidence, log weights of steps ``step[from][to]``, and the prior."""

    weights: tuple[float, ...]
    step: tuple[tuple[float, float], tuple[float, float]]
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(good) of each line by forward-backward, on ratios good : bad."""
        z = np.clip(with_neighbours(x).astype(float) @ np.array(self.weights), -30, 30)
        e = np.exp(z).tolist()
        (bb, bg), (gb, gg) = [[math.exp(v) for v in row] for row in self.step]
        n = len(e)
        ahead = [0.0] * n  # good : bad, from the lines up to here
        ratio = e[0]
        ahead[0] = ratio
        for i in range(1, n):
            ratio = ahead[i] = e[i] * (bg + ratio * gg) / (bb + ratio * gb)
        out = np.empty(n)
        back = 1.0  # good : bad, from the lines after
        for i in range(n - 1, -1, -1):
            r = ahead[i] * back
            out[i] = r / (1 + r)
            evidence = back * e[i]
            back = (gb + evidence * gg) / (bb + evidence * bg)
        return out

    def share(self, x: np.ndarray, sizes: np.ndarray) -> float:
        """Expected share of the text that lies in good lines."""
        return float(np.average(self.marginals(x), weights=sizes))

    def score(self, raw: bytes) -> float:
        x, sizes = line_features(raw)
        if not len(x):
            return self.prior
        return 1 / (1 + math.exp(-self.slope * log_odds(self.share(x, sizes)) - self.shift))


def log_odds(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return math.log(share / (1 - share))


def calibrated(field: Field, docs: list[np.ndarray], sizes: list[np.ndarray], labels: list[int]) -> Field:
    """The field with the line from log odds of the share to log odds of a good document, by Newton steps."""
    u = np.array([log_odds(field.share(d, n)) for d, n in zip(docs, sizes)])
    x, y = np.stack([u, np.ones_like(u)], 1), np.array(labels)
    theta = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(y) + 1e-3 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, x.T @ (y - p) / len(y) - 1e-3 * (theta - [1.0, 0.0]))
    return replace(field, slope=float(max(theta[0], 0.1)), shift=float(theta[1]))


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, docs))
    x = np.zeros((len(docs), length, WIDTH))
    mask = np.zeros((len(docs), length), bool)
    for i, d in enumerate(docs):
        x[i, : len(d)] = with_neighbours(d)
        mask[i, : len(d)] = True
    return x, mask


def batch_gradient(x, mask, y, weights, step):
    """Gradient of the log-likelihood of one block of documents (labels constant within each)."""
    docs, length, _ = x.shape
    z = np.stack([np.zeros((docs, length)), x @ weights], axis=-1)
    trans = np.exp(step)
    ahead, scale = np.empty((docs, length, 2)), np.ones((docs, length))
    for t in range(length):
        a = np.exp(z[:, t] - z[:, t].max(axis=1, keepdims=True))
        if t:
            a = a * (ahead[:, t - 1] @ trans)
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
        if t:
            ahead[:, t] = np.where(mask[:, t, None], ahead[:, t], ahead[:, t - 1])
    back = np.ones((docs, length, 2))
    for t in range(length - 2, -1, -1):
        b = (np.exp(z[:, t + 1] - z[:, t + 1].max(axis=1, keepdims=True)) * back[:, t + 1]) @ trans.T
        back[:, t] = np.where(mask[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    p = ahead * back
    p /= p.sum(axis=2, keepdims=True)
    grad_w = np.einsum("dtk,dt->k", x, (y[:, None] - p[:, :, 1]) * mask)
    inner = mask[:, 1:]
    e = np.exp(z[:, 1:] - z[:, 1:].max(axis=2, keepdims=True)) * back[:, 1:]
    pair = ahead[:, :-1, :, None] * trans * e[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    seen = np.zeros((docs, 2, 2))
    seen[np.arange(docs), y, y] = inner.sum(axis=1)
    grad_s = (seen - (pair * inner[:, :, None, None]).sum(axis=1)).sum(axis=0)
    return grad_w, grad_s


def blocks_of(rows: list[tuple[np.ndarray, int]], most: int = 200_000):
    """Documents of like length, padded to the longest, at most ``most`` lines together (or one document)."""
    part: list[tuple[np.ndarray, int]] = []
    for row in sorted(rows, key=lambda r: len(r[0])):
        if part and (len(part) + 1) * len(row[0]) > most:
            yield (*padded([d for d, _ in part]), np.array([y for _, y in part]))
            part = []
        part.append(row)
        if len(part) == 128:
            yield (*padded([d for d, _ in part]), np.array([y for _, y in part]))
            part = []
    if part:
        yield (*padded([d for d, _ in part]), np.array([y for _, y in part]))


FLAT = ((0.0, 0.0), (0.0, 0.0))


def fit_field(
    docs: list[np.ndarray], sizes: list[np.ndarray], labels: list[int], rounds: int = 80, penalty: float = 1e-3, rate: float = 0.3
) -> Field:
    """Adam on the mean log-likelihood per line, then the calibration of document scores."""
    prior = float(np.mean(labels)) if labels else 0.5
    rows = [(d, n, int(y)) for d, n, y in zip(docs, sizes, labels) if len(d)]
    if len({y for *_, y in rows}) < 2:
        return Field((0.0,) * WIDTH, FLAT, prior, shift=log_odds(prior))
    blocks = list(blocks_of([(d, y) for d, _, y in rows]))
    total = sum(b[1].sum() for b in blocks)
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        grad = -penalty * theta
        for x, mask, y in blocks:
            gw, gs = batch_gradient(x, mask, y, theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
            grad = grad + np.concatenate([gw, gs.ravel()]) / total
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        theta[WIDTH:] = np.clip(theta[WIDTH:], -4, 4)
    step = tuple(tuple(map(float, r)) for r in theta[WIDTH:].reshape(2, 2))
    field = Field(tuple(map(float, theta[:WIDTH])), step, prior)
    return calibrated(field, *map(list, zip(*rows)))


def held_out(id_column):
    """Rows that no fit may see: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_field(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_fit_docs: int = 3000,
    max_fit_lines: int = 5000,
    max_fit_total: int = 400_000,
) -> Field:
    """Fit on labelled documents outside the held-out fold.

    The sample is bounded three ways, by a hash of the id: ``max_fit_docs`` documents, of these the ones with ``max_fit_lines`` lines at most, and of
    these the first with ``max_fit_total`` lines together. Only their features reach the driver (37 numbers a line). An id whose labels
    disagree is not used; of the texts of a repeated id the smallest one is.
    """
    picked = (
        labels.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .filter(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("k")))
        .groupBy("k")
        .agg(F.min("y").alias("y"), F.max("y").alias("most"))
        .filter("y = most")
        .select("k", "y", F.xxhash64("k").alias("h"))
        .orderBy("h", "k")
        .limit(max_fit_docs)
    )
    joined = keyed_text(docs, id_col, text_col).join(F.broadcast(picked), "k")
    rows = joined.groupBy("k").agg(F.first("y").alias("y"), F.first("h").alias("h"), F.min(F.coalesce("t", F.lit(""))).alias("t"))

    def features(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for raw, label, h in zip(raw_texts(batch), batch.column("y").to_pylist(), batch.column("h").to_pylist()):
                found, sizes = line_features(raw)
                if len(found) <= max_fit_lines:
                    out.append((label, h, len(found), found.tobytes(), sizes.tobytes()))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield batch_of(**{name: pa.array(c, kind) for name, c, kind in zip(("y", "h", "lines", "x", "n"), columns, kinds)})

    table, path = written(rows.mapInArrow(features, "y int, h long, lines long, x binary, n binary"), "fit-lines")
    last, total = None, 0
    for row in table.select("h", "lines").orderBy("h").collect():  # two numbers a document
        total += row.lines
        if total > max_fit_total and last is not None:
            break
        last = row.h
    got = table.filter(F.col("h") <= F.lit(last)).collect() if last is not None else []
    delete_path(docs.sparkSession, path)
    got = sorted(got, key=lambda r: (r.y, bytes(r.x)))  # the same fit whatever order tasks end in
    return fit_field(
        [np.frombuffer(r.x, np.float32).reshape(-1, N) for r in got], [np.frombuffer(r.n) for r in got], [r.y for r in got]
    )


def score_quality(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""

    def score(batches: Batches) -> Batches:
        for batch in batches:
            s = np.array([field.score(raw) for raw in raw_texts(batch)])
            yield batch_of(k=batch.column("k"), score=pa.array(s, pa.float64()), predicted=pa.array((s >= threshold).astype(np.int32)))

    scored = keyed_text(docs, id_col, text_col).mapInArrow(score, f"k {id_type(docs, id_col)}, score double, predicted int")
    return scored.select(F.col("k").alias(id_col), held_out(F.col("k")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, field: Field, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns, in one pass."""

    def keep(batches: Batches) -> Batches:
        for batch in batches:
            kept = pa.array([field.score(raw) >= threshold for raw in raw_texts(batch, text_col)], pa.bool_())
            yield batch.filter(kept)

    return docs.mapInArrow(keep, docs.schema)
