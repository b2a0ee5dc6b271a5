"""Small linear models fitted on the driver from a bounded sample, and byte n-gram features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textscan import buffers, row_slices

_U = np.uint64


def ngram_slots(data: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...], size: int):
    """For each order, a slot in 0..size-1 for the n-gram at every byte; `size` where it leaves its row."""
    wide = data.astype(np.uint32)
    last = bounds[1:]
    for n in orders:
        value = np.full(len(data), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            value[: len(data) - k if k else None] = (value[: len(data) - k if k else None] ^ wide[k:]) * np.uint32(0x01000193)
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        value ^= value >> np.uint32(12)
        slot = (value % np.uint32(size)).astype(np.int32)
        for k in range(1, n):  # the last n-1 bytes of a row start no whole n-gram
            at = last - k
            slot[at[(at >= bounds[:-1]) & (at >= 0)]] = size
        yield slot


def lowered(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


def histogram(column: pa.Array, orders: tuple[int, ...], size: int) -> np.ndarray:
    """Relative frequencies of hashed byte n-grams, a row for each text."""
    data, offsets = buffers(lowered(column))
    out = np.zeros((len(column), size), np.float32)
    for lo, hi in row_slices(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        total = np.zeros((hi - lo, size + 1), np.float64)
        for slot in ngram_slots(part, at, orders, size):
            total += np.bincount(row * (size + 1) + slot, minlength=(hi - lo) * (size + 1)).reshape(hi - lo, size + 1)
        total = total[:, :size]
        out[lo:hi] = total / np.maximum(total.sum(1, keepdims=True), 1)
    return out * 100


def decision(column: pa.Array, weights: np.ndarray, bias: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
    """histogram(column) @ weights + bias without building the histograms; weights: (size, columns)."""
    size = weights.shape[0]
    table = np.vstack([weights, np.zeros((1, weights.shape[1]))]).astype(np.float32)
    data, offsets = buffers(lowered(column))
    out = np.zeros((len(column), weights.shape[1]))
    for lo, hi in row_slices(offsets, 1 << 18):
        at = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        full = np.flatnonzero(np.diff(at))
        total, count = np.zeros((hi - lo, weights.shape[1])), np.zeros(hi - lo)
        if len(full):
            for slot in ngram_slots(part, at, orders, size):
                total[full] += np.add.reduceat(table[slot], at[full], axis=0, dtype=np.float64)
                count[full] += np.add.reduceat((slot < size).astype(np.int64), at[full])
        out[lo:hi] = 100 * total / np.maximum(count, 1)[:, None] + bias
    return out


def fit_svms(x: np.ndarray, sides: np.ndarray, strength: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Linear support vector machines (squared hinge, L2), one for each column of sides (-1 or 1), by accelerated full-batch gradient steps."""
    used = np.flatnonzero(x.any(0))
    full, x = x.shape[1], np.ascontiguousarray(x[:, used], np.float32)
    y = sides.astype(np.float32)
    up = y > 0
    share = np.where(up, 0.5 / np.maximum(1, up.sum(0)), 0.5 / np.maximum(1, (~up).sum(0))).astype(np.float32)
    k = y.shape[1]
    v = np.repeat(np.random.default_rng(0).normal(size=(len(used), 1)).astype(np.float32), k, 1)
    for _ in range(10):  # the largest curvature, by power steps
        v = x.T @ (share * (x @ v))
        v /= np.linalg.norm(v, axis=0) + 1e-30
    top = (share * (x @ v) ** 2).sum(0) + 1.0
    step, strength = (1 / (2 * top + strength)).astype(np.float32), np.float32(strength)
    w, b = np.zeros((len(used), k), np.float32), np.zeros(k, np.float32)
    pw, pb = w, b
    for t in range(rounds):
        m = np.float32(t / (t + 3))
        lw, lb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ lw + lb)) * share * y
        pw, pb = w, b
        w = lw + step * (2 * (x.T @ slack) - strength * lw)
        b = lb + step * 2 * slack.sum(0)
    out = np.zeros((full, k))
    out[used] = w
    return out, b.astype(np.float64)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, strength: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """L2 logistic regression by accelerated full-batch gradient steps; y in 0..1 may be soft."""
    n, d = x.shape
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    share = (np.full(n, 1 / max(n, 1)) if weight is None else weight / max(weight.sum(), 1e-12)).astype(np.float32)
    v = np.random.default_rng(0).normal(size=d).astype(np.float32)
    for _ in range(10):
        v = x.T @ (share * (x @ v))
        v /= np.linalg.norm(v) + 1e-30
    top = float((share * (x @ v) ** 2).sum()) + 1.0
    step = 1 / (top / 2 + strength)
    w, b, pw, pb = np.zeros(d, np.float32), np.float32(0), np.zeros(d, np.float32), np.float32(0)
    step, strength = np.float32(step), np.float32(strength)
    for t in range(rounds):
        m = np.float32(t / (t + 3))
        lw, lb = w + m * (w - pw), b + m * (b - pb)
        gap = (y - sigmoid(x @ lw + lb)) * share
        pw, pb = w, b
        w = lw + step * (x.T @ gap - strength * lw)
        b = lb + step * gap.sum()
    return w.astype(np.float64), float(b)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (smoothed targets, Newton steps)."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    unit = float(np.abs(margin).mean()) or 1.0
    x = margin / unit

    def loss(a: float, b: float) -> float:
        z = np.clip(a * x + b, -40, 40)
        return float((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - target * z).sum() + 5e-4 * a * a)

    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * x).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        move, step, now = np.linalg.solve(hess, grad), 1.0, loss(a, b)
        while step > 1e-6 and loss(a - step * move[0], b - step * move[1]) > now:
            step /= 2  # Newton's step is shortened until the loss falls
        a, b = a - step * move[0], b - step * move[1]
        if np.abs(step * move).max() < 1e-9:
            break
    return float(max(a, 1e-3)) / unit, float(b)


def bounded_sample(df, key: str, per_key: int, id_col: str, seed: str, most: int | None = None):
    """About per_key rows of each value of key (a column name), chosen by a hash of the id.

    most: bound on all rows together; many values then share it evenly, and each keeps its part.
    One aggregation counts the values (one row for each reaches the driver);
    each then gets a rate, so no window gathers a value's rows in one task.  A
    last limit, put by the caller on what it made of the rows, bounds them even
    where hashes fall badly.  Gives the rows, that limit and the counts.
    """
    from pyspark.sql import functions as F

    counts = {r[key]: r["n"] for r in df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).collect()}
    if not counts:
        return df.limit(0), 0, counts
    if most:
        per_key = max(8, min(per_key, most // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1 << 30))
    names, rates = F.array(*[F.lit(v) for v in counts]), F.array(*[F.lit(int(min(1.0, per_key / n) * (1 << 30))) for n in counts.values()])
    rate = F.element_at(F.map_from_arrays(names, rates), F.col(key))
    return df.filter(draw < rate), 2 * per_key * len(counts), counts


def pack_rows(x: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The filled places of each row of x and their values, as bytes, which is how training rows travel."""
    places = [np.flatnonzero(r).astype("<u4") for r in x]
    return pa.array([p.tobytes() for p in places], pa.binary()), pa.array([r[p].astype("<f4").tobytes() for r, p in zip(x, places)], pa.binary())


def unpack_rows(places: pa.Array, values: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(places), width), np.float32)
    for i, (p, v) in enumerate(zip(places, values)):
        out[i, np.frombuffer(p.as_py(), "<u4")] = np.frombuffer(v.as_py(), "<f4")
    return out
