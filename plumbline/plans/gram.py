"""Sums over all pairs of many columns, as products of blocks of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256  # columns to a side of what is shuffled and added up
PANEL = 2048  # columns whose products one scan holds in a task
ROWS = 2048  # rows multiplied at a time
ADDED = 6  # of a tile's ten matrices, these are sums; then two least and two largest values
TILES = "a int, b int, part int, data binary"
PAIRS = "i int, j int, n long, sx double, sy double, sxy double, sxx double, syy double, varies boolean"


def _products(columns: int, left: int):
    """Tiles of what the rows of a task add up to, for pairs of the first ``left`` columns with all others."""
    import numpy as np
    import pyarrow as pa

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (columns, columns)
        n, s, q, p = (np.zeros(shape) for _ in range(4))  # counts, sums, squares (of row where column), products
        low, high = np.full(shape, np.nan), np.full(shape, np.nan)
        part, seen = 0, False
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                part, seen = rows.column(0)[0].as_py(), True
                # A missing value comes as NaN.
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in rows.columns[1:]]).astype(float, copy=False)
                there = ~np.isnan(x)
                full = there.all(axis=0)
                mask = there.astype(float)
                filled = np.where(there, x, 0.0)
                n += mask.T @ mask
                s += filled.T @ mask
                q += (filled * filled).T @ mask
                p += filled.T @ filled
                low[:, full] = np.fmin(low[:, full], np.fmin.reduce(x)[:, None])
                high[:, full] = np.fmax(high[:, full], np.fmax.reduce(x)[:, None])
                for j in np.flatnonzero(~full):
                    held = x[there[:, j]]
                    if len(held):
                        low[:, j] = np.fmin(low[:, j], np.fmin.reduce(held))
                        high[:, j] = np.fmax(high[:, j], np.fmax.reduce(held))
        if not seen:
            return
        for a in range(0, left, TILE):
            for b in range(a if left == columns else left, columns, TILE):
                i, j = slice(a, a + TILE), slice(b, b + TILE)
                tile = [n[i, j], s[i, j], s[j, i].T, p[i, j], q[i, j], q[j, i].T]
                tile += [low[i, j], low[j, i].T, high[i, j], high[j, i].T]
                data = np.ascontiguousarray(np.stack(tile)).tobytes()
                yield pa.RecordBatch.from_pydict(
                    {"a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()),
                     "part": pa.array([part], pa.int32()), "data": pa.array([data], pa.binary())}
                )

    return multiply


def _added(columns: int, offsets: list[int] | None):
    """Neighbouring tiles of equal (a, b, part) put together; as pairs if ``offsets`` number the columns."""
    import numpy as np
    import pyarrow as pa

    def pairs(a: int, b: int, tile) -> pa.RecordBatch:
        sides = np.array(offsets)
        i, j = np.meshgrid(np.arange(a, min(a + TILE, columns)), np.arange(b, min(b + TILE, columns)), indexing="ij")
        keep = sides[i] < sides[j]
        n, sx, sy, sxy, sxx, syy, low_x, low_y, high_x, high_y = (m[keep] for m in tile)
        varies = (low_x < high_x) & (low_y < high_y)
        listed = [
            sides[i][keep].astype(np.int32), sides[j][keep].astype(np.int32), n.round().astype(np.int64),
            sx, sy, sxy, sxx, syy, varies,
        ]
        return pa.RecordBatch.from_arrays(list(map(pa.array, listed)), names=[part.split()[0] for part in PAIRS.split(", ")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def given() -> pa.RecordBatch:
            if offsets is not None:
                return pairs(key[0], key[1], total)
            return pa.RecordBatch.from_pydict(
                {**{name: pa.array([v], pa.int32()) for name, v in zip("abg", key, strict=True)},
                 "data": pa.array([total.tobytes()], pa.binary())}
            ).rename_columns(["a", "b", "part", "data"])

        for batch in batches:
            for a, b, part, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                at = (a.as_py(), b.as_py(), part.as_py())
                sides = (min(TILE, columns - at[0]), min(TILE, columns - at[1]))
                tile = np.frombuffer(data.as_buffer(), float).reshape(10, *sides)
                if at != key:
                    if key is not None:
                        yield given()
                    key, total = at, tile.copy()
                else:
                    total[:ADDED] += tile[:ADDED]
                    total[ADDED : ADDED + 2] = np.fmin(total[ADDED : ADDED + 2], tile[ADDED : ADDED + 2])
                    total[ADDED + 2 :] = np.fmax(total[ADDED + 2 :], tile[ADDED + 2 :])
        if key is not None:
            yield given()

    return add


def pair_sums(df: DataFrame, cells: list[str]) -> DataFrame:
    """``i, j, n, sx, sy, sxy, sxx, syy, varies`` of each pair ``i < j`` of ``cells``.

    ``cells`` are SQL doubles, NULL where missing; sums are over the rows complete in the
    pair, ``varies`` says whether both take more than one value there. Tasks multiply blocks
    of rows, with masks in place of missing values, and give tiles of the products. Tiles
    are added up in two levels, each a stream: a task holds one sum and one tile. Up to
    ``PANEL`` columns take one scan; more take one for each pair of half panels, so that a
    task's products stay bounded.
    """
    numbers = list(range(len(cells)))
    if len(cells) <= PANEL:
        return _panel(df, cells, numbers, len(cells))
    half = PANEL // 2
    panels = [numbers[i : i + half] for i in range(0, len(cells), half)]
    out = None
    for i, left in enumerate(panels):
        for right in panels[i:]:
            both = left if right is left else left + right
            part = _panel(df, cells, both, len(left))
            out = part if out is None else out.unionByName(part)
    return out


def _panel(df: DataFrame, cells: list[str], numbers: list[int], left: int) -> DataFrame:
    width = len(numbers)
    listed = [f"coalesce({cells[k]}, double('nan')) AS x{k}" for k in numbers]
    tiles = df.selectExpr("spark_partition_id() AS part", *listed).mapInArrow(_products(width, left), TILES)
    parts = max(1, math.isqrt(df.sparkSession.sparkContext.defaultParallelism))
    grouped = tiles.withColumn("part", F.pmod("part", F.lit(parts)).cast("int"))
    order = ["a", "b", "part"]
    once = grouped.repartition(*order).sortWithinPartitions(*order).mapInArrow(_added(width, None), TILES)
    last = once.withColumn("part", F.lit(0)).repartition("a", "b").sortWithinPartitions("a", "b")
    return last.mapInArrow(_added(width, numbers), PAIRS)
