"""Pairs of a file's chunks from rows sorted by file and start line: a file's chunks are held, its pairs never are.

Names meet as runs of equal codes and neighbours as stretches of start lines, so that no pair is met that shares nothing. A
chunk's pairs with all later chunks are told together, ``SLAB`` or so at once, each pair once with what it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Met pairs that are held at once (more only where one chunk alone has more), and lines of a neighbour.
SLAB, REACH = 1 << 18, 5
#: Shared functions and imports are counted in 31 bits each, above them stands whether the chunks are neighbours.
_COUNT, _MASK = 31, (1 << 31) - 1


def _by_name(names: pa.ListArray, file: np.ndarray) -> tuple[np.ndarray, ...]:
    """chunk, low, high and partner: the chunks partner[low:high] are later ones of its file that have a name of chunk's."""
    flat = pc.list_flatten(names)
    some = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    chunk = pc.list_parent_indices(names).to_numpy(zero_copy_only=False)[some].astype(np.int64)
    word = pc.drop_null(flat).dictionary_encode()
    key = file[chunk] * max(1, len(word.dictionary)) + word.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key, partner = key[order], chunk[order]
    back = np.argsort(partner, kind="stable")
    return partner[back], back + 1, np.searchsorted(key, key, "right")[back], partner


def _beside(file: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``_by_name``, for chunks that start ``REACH`` lines at most from chunk's end."""
    line, every = (file << 34) + start, np.arange(len(file))
    low = np.maximum(np.searchsorted(line, (file << 34) + end - REACH), np.searchsorted(line, line, "right"))
    return every, low, np.maximum(low, np.searchsorted(line, (file << 34) + end + REACH, "right")), every


def _told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs of whole files."""
    path, first = rows["file_path"].combine_chunks(), rows["start_line"].combine_chunks()
    file = path.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start = first.to_numpy(zero_copy_only=False).astype(np.int64)
    # a chunk without an end is nobody's neighbour
    end = pc.coalesce(rows["end_line"].cast(pa.int64()), pc.subtract(rows["start_line"].cast(pa.int64()), 2 * REACH)).to_numpy()
    met = [(*_by_name(rows[x].combine_chunks(), file), one) for x, one in (("functions", 1), ("imports", 1 << _COUNT))] + [(*_beside(file, start, end), 1 << 2 * _COUNT)]
    n = len(file)
    total = np.cumsum(sum(np.bincount(chunk, high - low, n) for chunk, low, high, _, _ in met).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(total // SLAB)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        codes, ones = [], []
        for chunk, low, high, partner, one in met:
            own = slice(*np.searchsorted(chunk, [a, b]))
            size = high[own] - low[own]
            at = np.arange(size.sum()) + np.repeat(low[own] - np.cumsum(size) + size, size)
            left, right = np.repeat(chunk[own], size), partner[at]
            ahead = start[left] < start[right]
            codes.append((left * n + right)[ahead])
            ones.append(np.full(len(codes[-1]), one))
        code = np.concatenate(codes)
        if not len(code):
            continue
        order = np.argsort(code, kind="stable")
        code = code[order]
        new = np.flatnonzero(np.diff(code, prepend=-1))
        shared = np.add.reduceat(np.concatenate(ones)[order], new)
        left, right = np.divmod(code[new], n)
        told = [path.take(pa.array(left)), first.take(pa.array(left)), first.take(pa.array(right)), pa.array(shared & _MASK), pa.array(shared >> _COUNT & _MASK), pa.array(shared >> 2 * _COUNT > 0)]
        yield pa.RecordBatch.from_arrays(told, names=["file_path", "first", "second", "f", "i", "seq"])


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file_path, first, second (start lines), f, i (how many functions and imports they share) and seq (whether the second
    starts ``REACH`` lines at most from the first's end) of all pairs that share something, the second starting later.

    ``batches`` has file_path, start_line, end_line, functions and imports, sorted by file and start line; a file may go on
    in the next batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column("file_path")
        other = np.flatnonzero(pc.not_equal(path, path[-1]).to_numpy(zero_copy_only=False))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or held and held[-1].column("file_path")[-1].as_py() != path[0].as_py():
            yield from _told(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _told(pa.Table.from_batches(held))
