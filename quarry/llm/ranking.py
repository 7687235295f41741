"""Quantiles and Bradley-Terry weights of all rows of a table, by passes over it that bring back sums alone.

A pass applies a function to blocks of rows and merges the arrays of floats that it returns, so what reaches the driver
grows with the tasks, not with the rows, and beyond ``FAN`` tasks not with these either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import lean, spread, squeeze, text_bytes
from quarry.llm.linear import logistic

BLOCK, FAN = 1 << 14, 64
#: Cells of worth: those that losses and pushes are read off, and those of the curvature, which only steers the steps.
CELLS, COARSE = 1 << 13, 1 << 7
RIDGE, ROUNDS = 1e-4, 60

#: Merges, by np.add or np.minimum, what the function makes of each block of rows x and their classes y (0 or 1);
#: None if there are no rows.
Pass = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray], np.ufunc], np.ndarray | None]


def here(x: np.ndarray, y: np.ndarray) -> Pass:
    return lambda part, merge: part(x, y) if len(y) else None


def _blocks(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    xs, ys, rows = [], [], 0
    for batch in batches:
        xs.append(text_bytes(batch.column("x"))[0])
        ys.append(batch.column("y").to_numpy(zero_copy_only=False))
        rows += batch.num_rows
        if rows >= BLOCK:
            yield np.concatenate(xs).view(kind).reshape(rows, -1), np.concatenate(ys)
            xs, ys, rows = [], [], 0
    if rows:
        yield np.concatenate(xs).view(kind).reshape(rows, -1), np.concatenate(ys)


def over(df: DataFrame, kind: str) -> Pass:
    """Passes over a written table of x binary (as many numbers of the numpy type ``kind`` in each row) and y int."""
    df, schema = lean(df), "part int, total binary"
    many = df.rdd.getNumPartitions() > FAN

    def total(part: Callable, merge: np.ufunc) -> np.ndarray | None:
        def out(found: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([squeeze(found)], pa.binary())], names=["part", "total"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for x, y in _blocks(batches, kind):
                found = part(x, y) if found is None else merge(found, part(x, y))
            yield from out(found)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                for one in batch.column("total"):
                    one = spread(one.as_py(), np.float64)
                    found = one if found is None else merge(found, one)
            yield from out(found)

        totals = df.mapInArrow(run, schema)
        if many:
            totals = totals.repartition(FAN, F.col("part") % FAN).sortWithinPartitions("part").mapInArrow(again, schema)
        found = None
        for row in sorted(totals.collect()):
            one = spread(bytes(row["total"]), np.float64)
            found = one if found is None else merge(found, one)
        return found

    return total


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = np.ascontiguousarray(values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _numbers(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def quantiles(rows: Pass, of: Callable[[np.ndarray], np.ndarray], column: np.ndarray, goal: np.ndarray, weight: np.ndarray, digit: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """For each goal the least value, in that column of ``of(x)``, for which the rows up to it weigh ``goal``, and the
    next greater value (infinite if none); exact, a digit of ``digit`` bits a pass. ``weight``: of a row of each class."""
    goal, below, prefix = goal * (1 - 1e-12), np.zeros(len(goal)), np.zeros(len(goal), np.uint64)
    span, wide = 1 << digit, np.uint64(digit)
    for low in range(64 - digit, -1, -digit):
        shift = np.uint64(low)
        cells = sorted(set(zip(column.tolist(), prefix.tolist(), strict=True)))

        def part(x: np.ndarray, y: np.ndarray, cells: list = cells, shift: np.uint64 = shift) -> np.ndarray:
            keys, out = _keys(of(x)) >> shift, []
            for c, p in cells:
                mine = keys[:, c] >> wide == np.uint64(p)
                out.append(np.bincount((keys[mine, c] & np.uint64(span - 1)).astype(np.int64) + span * y[mine], minlength=2 * span))
            return np.concatenate(out).astype(float)

        found = rows(part, np.add).reshape(len(cells), 2, span)
        heavy = dict(zip(cells, found[:, 0] * weight[0] + found[:, 1] * weight[1], strict=True))
        for t in range(len(goal)):
            held = heavy[int(column[t]), int(prefix[t])]
            reach = below[t] + np.cumsum(held)
            d = min(int(np.searchsorted(reach, goal[t])), int(np.flatnonzero(held)[-1]))
            below[t] = reach[d] - held[d]
            prefix[t] = (prefix[t] << wide) | np.uint64(d)
    value = _numbers(prefix)

    def after(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        seen = of(x)
        return np.array([np.min(seen[:, c], initial=np.inf, where=seen[:, c] > v) for c, v in zip(column, value, strict=True)])

    return value, rows(after, np.minimum)


def _facing(share: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """For each cell a the sum over cells b of share[b] * kernel(a - b), the kernel given from 1 - CELLS to CELLS - 1."""
    wide = 4 * CELLS
    return np.fft.irfft(np.fft.rfft(share, wide) * np.fft.rfft(kernel, wide), wide)[CELLS - 1 : 2 * CELLS - 1]


def ranked(rows: Pass, measures: int, bins: int, n: np.ndarray) -> np.ndarray:
    """Weights of one-hot features (``bins`` for each measure; x holds their numbers) that minimise the mean logistic
    loss over all pairs of a row of class 1 above one of class 0, plus a ridge, by ``ROUNDS`` Newton steps at most.

    A pair's loss depends on two worths alone. So one pass counts each class's worths in cells (shared between two cells
    by distance), from which the driver has the loss and the mean push of all rows of the other class on any worth; a
    second pass sums pushes. ``n``: rows of class 0 and of class 1.
    """
    size, first, ratio = measures * bins, np.arange(measures) * bins, CELLS // COARSE

    def place(hot: np.ndarray, w: np.ndarray, low: float, step: float) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip((w[hot].sum(axis=1) - low) / step, 0, CELLS - 1.001)
        cell = at.astype(np.int64)
        return cell, at - cell

    def look(w: np.ndarray) -> tuple:
        """The loss at w, and what ``slopes`` needs."""
        table = w.reshape(measures, bins)
        low = float(table.min(axis=1).sum())
        step = max(float(table.max(axis=1).sum()) - low, 1e-6) / (CELLS - 1)

        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            cell, past = place(x + first, w, low, step)
            mine = y * CELLS + cell
            return np.concatenate([np.bincount(mine, 1 - past, 2 * CELLS) + np.bincount(mine + 1, past, 2 * CELLS), np.bincount(y * COARSE + cell // ratio, minlength=2 * COARSE)])

        found = rows(part, np.add)
        share, coarse = found[: 2 * CELLS].reshape(2, CELLS) / n[:, None], found[2 * CELLS :].reshape(2, COARSE)
        ahead = step * np.arange(1 - CELLS, CELLS)
        loss = float(share[1] @ _facing(share[0], np.logaddexp(0, -ahead))) + RIDGE / 2 * float(w @ w)
        push = np.stack([_facing(share[1], logistic(ahead)) / n[0], -_facing(share[0], logistic(-ahead)) / n[1]])
        return loss, push, coarse, low, step

    def slopes(w: np.ndarray, seen: tuple) -> tuple[np.ndarray, np.ndarray]:
        _, push, coarse, low, step = seen
        p = logistic(step * ratio * (np.arange(COARSE)[:, None] - np.arange(COARSE)))
        bend = p * (1 - p) / (n[0] * n[1])
        mine = np.concatenate([bend @ coarse[1], bend @ coarse[0]])

        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            hot = x + first
            cell, past = place(hot, w, low, step)
            pull = push[y, cell] * (1 - past) + push[y, cell + 1] * past
            group = y * COARSE + cell // ratio
            one = np.zeros((len(y), size), np.float32)
            one[np.arange(len(y))[:, None], hot] = 1
            return np.concatenate([
                np.bincount(hot.ravel(), np.repeat(pull, measures), size), (one.T @ (one * mine[group].astype(np.float32)[:, None])).ravel(),
                np.bincount((group[:, None] * size + hot).ravel(), minlength=2 * COARSE * size),
            ])

        found = rows(part, np.add)
        bad, good = found[size + size**2 :].reshape(2, COARSE, size)
        across = good.T @ bend @ bad
        return found[:size] + RIDGE * w, found[size : size + size**2].reshape(size, size) - across - across.T + RIDGE * np.eye(size)

    w = np.zeros(size)
    seen = look(w)
    for _ in range(ROUNDS):
        gradient, curve = slopes(w, seen)
        way = -np.linalg.solve(curve, gradient)
        gain, stride = -float(gradient @ way), 1.0
        if gain < 1e-8:
            break
        while (ahead := look(w + stride * way))[0] > seen[0] - 1e-4 * stride * gain and stride > 1e-3:
            stride /= 2
        if ahead[0] >= seen[0]:
            break
        w, seen = w + stride * way, ahead
    return w
