"""The two nearest points of each query, by tiles of points and queries.

Points and queries are dealt to tiles of bounded size; every tile of points meets every tile of queries in a task of its own,
which sends on the two nearest of each of its queries. Within a task, matrix products give all distances up to a bound on their
rounding, and only the pairs that this bound leaves open are computed as defined: the squares of the differences added up in
the order of the components, as doubles. So the results, ties included, are those of computing every pair.

Defined results: a component that either of the two lacks (null, or beyond its end) is left out; a pair with no component in
common has no distance and comes after all others; NaN comes after all numbers; ties go by the least key; rows with a null
key take no part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Numbers (components) in a tile of points or queries on average, and pairs of which a task holds the distances at once.
TILE_NUMBERS, HELD_PAIRS = 1 << 18, 1 << 20
#: Vectors with a greater component are compared as defined from the start, so that no product is beyond the doubles.
GREATEST = 1e100


class _Vectors:
    """A tile's vectors as a matrix of doubles, zeros where a component is missing."""

    def __init__(self, column: pa.ChunkedArray, width: int):
        rows = column.combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(rows)
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.values, self.there = np.zeros((len(lengths), width)), np.zeros((len(lengths), width), bool)
        self.values[row, at] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        self.there[row, at] = pc.is_valid(flat).to_numpy(zero_copy_only=False)
        self.plain = self.there.all(axis=1) & (np.abs(self.values) < GREATEST).all(axis=1)


def _distances(p: _Vectors, q: _Vectors, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distances of queries `rows` and points `cols`, as defined, and whether there is one."""
    total, known = np.zeros(len(rows)), np.zeros(len(rows), bool)
    with np.errstate(all="ignore"):
        for i in range(p.values.shape[1]):
            both = p.there[cols, i] & q.there[rows, i]
            away = p.values[cols, i] - q.values[rows, i]
            total += np.where(both, away * away, 0.0)
            known |= both
        return np.sqrt(total), known


def _width(column: pa.ChunkedArray) -> int:
    return pc.max(pc.list_value_length(column)).as_py() or 0


def _tile(points: pa.Table, queries: pa.Table, schema: pa.Schema) -> pa.Table:
    if not len(points) or not len(queries):
        return schema.empty_table()
    width = max(_width(points["pv"]), _width(queries["qv"]))
    p, q = _Vectors(points["pv"], width), _Vectors(queries["qv"], width)
    keys = pc.rank(pa.chunked_array([*points["point"].chunks, *queries["query"].chunks]), tiebreaker="dense").to_numpy()
    pk, qk = keys[: len(points)].astype(np.int64), keys[len(points) :].astype(np.int64)

    plain, others = np.flatnonzero(p.plain), np.flatnonzero(~p.plain)
    values, by_key = p.values[plain], np.argsort(pk[plain], kind="stable")
    sorted_keys = pk[plain][by_key]
    norms = np.einsum("ij,ij->i", values, values)
    greatest = norms.max(initial=0.0)
    error = (8 * width + 64) * 2.0**-53  # of |p|^2 + |q|^2, the distance's own rounding and that of its root included

    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, HELD_PAIRS // len(points))
    for start in range(0, len(queries), step):
        at = np.arange(start, min(start + step, len(queries)))
        fast = at[q.plain[at]] if len(plain) else at[:0]
        slow = np.setdiff1d(at, fast, assume_unique=True)
        rows, cols = [np.repeat(slow, len(points)), np.repeat(fast, len(others))], [np.tile(np.arange(len(points)), len(slow)), np.tile(others, len(fast))]
        if len(fast):
            near = (-2.0 * q.values[fast]) @ values.T + norms  # less |q|^2
            low, high = np.searchsorted(sorted_keys, qk[fast], "left"), np.searchsorted(sorted_keys, qk[fast], "right")
            for k in np.flatnonzero(high > low):
                near[k, by_key[low[k] : high[k]]] = np.inf
            each = np.arange(len(fast))
            first = near.argmin(axis=1)
            least = near[each, first]
            near[each, first] = np.inf
            second = near.min(axis=1)
            near[each, first] = least
            limit = second + 2 * error * (np.einsum("ij,ij->i", q.values[fast], q.values[fast]) + greatest)
            k, c = np.nonzero(near <= limit[:, None])
            rows.append(fast[k])
            cols.append(plain[c])
        row, col = np.concatenate(rows), np.concatenate(cols)
        other = qk[row] != pk[col]
        row, col = row[other], col[other]
        parts = [_distances(p, q, row[i : i + HELD_PAIRS], col[i : i + HELD_PAIRS]) for i in range(0, len(row), HELD_PAIRS)]
        if parts:
            d, known = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pk[col], np.where(known, d, 0.0), np.isnan(d), ~known, row))
            ranked = row[order]
            place = np.arange(len(order)) - np.searchsorted(ranked, ranked, "left")
            best = order[place < 2]
            found.append((row[best], col[best], d[best], known[best]))
    if not found:
        return schema.empty_table()
    row, col, d, known = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table([queries["query"].take(pa.array(row)), points["point"].take(pa.array(col)), pa.array(d, mask=~known)], schema=schema)


def two_of_each_tile(points: DataFrame, queries: DataFrame, key: str, values: str) -> DataFrame:
    """(query, point, d): of each query and tile of points the two nearest, so that the two nearest of all are among them.

    The sizes of both sides are looked up first, at once, for the number of tiles."""
    p = points.select(F.col(key).alias("point"), F.col(values).alias("pv")).where("point IS NOT NULL")
    q = queries.select(F.col(key).alias("query"), F.col(values).alias("qv")).where("query IS NOT NULL")
    tiles = lambda df, v: max(1, -(-(df.agg(F.sum(F.coalesce(F.size(v), F.lit(0)) + 1)).first()[0] or 0) // TILE_NUMBERS))
    np_, nq = tiles(p, "pv"), tiles(q, "qv")
    deal = lambda n, *on: F.pmod(F.xxhash64(*on), F.lit(n)).cast("int")
    left = p.withColumn("_p", deal(np_, "point", "pv")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = q.withColumn("_q", deal(nq, "query", "qv")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))))
    out = StructType([StructField("query", q.schema["query"].dataType), StructField("point", p.schema["point"].dataType), StructField("d", DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = [("query", b.schema.field("query").type), ("point", a.schema.field("point").type), ("d", pa.float64())]
        return _tile(a, b, pa.schema(kinds))

    return left.groupBy("_p", "_q").cogroup(right.groupBy("_p", "_q")).applyInArrow(run, out)
