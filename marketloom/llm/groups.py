"""Groups of consecutive rows in partitions that are sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups; several small groups come together, split them with ``borders``."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        cut = int(borders(t, keys)[-2]) if t.num_rows else 0
        # Rows of the last group may go on in the next batch.
        cut += held.num_rows - t.num_rows
        if cut and not (cut == held.num_rows - t.num_rows and _same(held, cut - 1, cut, keys)):
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _same(t: pa.Table, i: int, j: int, keys: list[str]) -> bool:
    return all(t[k][i].as_py() == t[k][j].as_py() for k in keys)


def borders(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of ``t`` begins, and the number of rows."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = t[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def binaries(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column as one flat array, and the offsets of its rows."""
    from marketloom.llm.textops import flat

    data, offsets = flat(column)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(np.ascontiguousarray(data), dtype), offsets // size


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the edges (between places below ``n``) that form a spanning forest."""
    parent = list(range(n))
    kept = []
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return np.array(kept, np.int64)
