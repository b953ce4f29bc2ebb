"""Percentiles per group from dyadic Count-sketches that add up over partitions and days.

Each value is encoded as an unsigned 32-bit number in the same order. For every binary resolution of that
number there is one signed Count-sketch of its prefixes; the coarsest resolutions, with no more prefixes
than a sketch has cells, are counted exactly. A sketch is linear: sketches of separate partitions or days
merge by adding cells, and negative weights delete. Empty cells are not stored.

Each task sketches what it scans and ships cells only, as rows (keys, cells) of bounded size of which a
group may have any number: together they are its sketch. Merging adds them in streams, over many scan
partitions first within as many bundles per group as the square root of their number, so no task holds
or reads all of a hot group.

A percentile is found by descending from the coarsest resolution: at each level the estimated weight of
the left half tells which half holds the rank. Errors of the 19 sketched levels are independent and
without bias. Of the 5 cells asked, 3 must be hit by one of the 60 heaviest prefixes to disturb the median,
which has a chance of 2.5e-4 a level, 0.5 % in all; the other prefixes, each below 1/60 of the weight,
give a cell a standard error below 1/sqrt(60 * 2048), the median of five about half of that, and the sum
over the levels below 0.7 % of the weight. So the rank error is at most ``RANK_ERROR`` of the group's
weight with a probability of 0.99 for the worst input; for values as they come it is about a tenth of that.

Defined cases: null values are left out; negative and very large values count like all others (32-bit
integers); null keys make a group of their own; repeated rows count repeatedly; a group whose weights
cancel out gives no row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.session import table

DEPTH = 5
WIDTH = 2048
BITS = 32
STRIDE = DEPTH * WIDTH
#: Levels below this one are sketched; the others have at most as many prefixes as a sketch has cells.
SKETCHED = BITS - int(math.log2(STRIDE))
PERCENTS = (50, 90, 95, 99)
RANK_ERROR = 0.01
OFFSET = 1 << 31
#: A cell's number within a group's sketch takes so many bits.
CELL_BITS = int(BITS * STRIDE).bit_length()
#: Sizes of what a task holds: counted values, values that are sketched at once, cells that are added at once, cells of a row.
HELD, AT_ONCE, ADDED, ROW_CELLS = 1_000_000, 40_000, 2_000_000, 4096

_SEEDS = np.random.default_rng(20240607).integers(1, 2**63 - 1, size=(BITS, DEPTH, 2), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def places(prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of each prefix in one sketch row."""
    a, b = _SEEDS[level, row]
    h = (prefix + np.uint64(1)) * a
    h ^= h >> np.uint64(31)
    h = h * b
    h ^= h >> np.uint64(29)
    return (h & np.uint64(WIDTH - 1)).astype(np.int64), 1 - 2 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of equal keys added up, in order of keys, without those that cancel out."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], dtype=np.int64)
    total = np.add.reduceat(weights, starts) if len(starts) else weights
    kept = total != 0
    return keys[starts][kept], total[kept]


def cells_of(group: np.ndarray, values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (group number and cell number in one key) of encoded values, which come sorted by group and value."""
    keys, parts = [], []
    g, v, w = group.astype(np.int64), values.astype(np.uint64), weights.astype(np.int64)
    for level in range(BITS):
        if level:  # the next coarser prefixes; neighbours that become equal are one from now on
            v = v >> np.uint64(1)
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
            g, v, w = g[starts], v[starts], np.add.reduceat(w, starts)
        base = (g << CELL_BITS) + level * STRIDE
        if level >= SKETCHED:
            keys.append(base + v.astype(np.int64))
            parts.append(w)
            continue
        for row in range(DEPTH):
            column, sign = places(v, level, row)
            keys.append(base + row * WIDTH + column)
            parts.append(w * sign)
    return summed(np.concatenate(keys), np.concatenate(parts))


def weight_at(keys: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, weights[at], 0)


def invert(keys: np.ndarray, weights: np.ndarray, groups: int, percents: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each group, value of each group and percent) by descending the levels."""
    if not len(keys):
        return np.zeros(groups, dtype=np.int64), np.zeros((groups, len(percents)), dtype=np.int64)
    every = np.arange(groups, dtype=np.int64)[:, None] << CELL_BITS
    top = every + (BITS - 1) * STRIDE
    total = (weight_at(keys, weights, top) + weight_at(keys, weights, top + 1))[:, 0]
    mass = np.repeat(total[:, None].astype(np.float64), len(percents), axis=1)
    rank = np.maximum(1.0, np.ceil(mass * np.array(percents) / 100))
    prefix = np.zeros(mass.shape, dtype=np.uint64)
    for level in range(BITS - 1, -1, -1):
        left = prefix << np.uint64(1)
        if level >= SKETCHED:
            seen = weight_at(keys, weights, every + level * STRIDE + left.astype(np.int64)).astype(np.float64)
        else:
            rows = []
            for row in range(DEPTH):
                column, sign = places(left, level, row)
                rows.append(weight_at(keys, weights, every + level * STRIDE + row * WIDTH + column) * sign)
            seen = np.median(rows, axis=0)
        seen = np.clip(seen, 0.0, np.maximum(mass, 0.0))
        right = rank > seen
        prefix = left + right.astype(np.uint64)
        rank, mass = np.where(right, rank - seen, rank), np.where(right, mass - seen, seen)
    return total, prefix.astype(np.int64) - OFFSET


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of unsigned numbers, seven bits a byte, and where each number begins."""
    length = np.ones(len(numbers), dtype=np.int64)
    for k in range(1, 10):
        length += numbers >= np.uint64(1 << (7 * k))
    ends = np.cumsum(length)
    begins = ends - length
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(length.max(initial=0))):
        here = length > k
        more = (length[here] > k + 1).astype(np.uint64) << np.uint64(7)
        out[begins[here] + k] = (((numbers[here] >> np.uint64(7 * k)) & np.uint64(127)) | more).astype(np.uint8)
    return out, begins


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    begins = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data & np.uint8(127)).astype(np.uint64) << (place * 7).astype(np.uint64), begins) if len(ends) else np.array([], dtype=np.uint64)


def encoded(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(group of each row, its cells) in rows of at most ``ROW_CELLS`` cells: gaps and weights by turns."""
    group, cell = keys >> CELL_BITS, keys & ((1 << CELL_BITS) - 1)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(keys) else np.array([], dtype=np.int64)
    place = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
    opens = place % ROW_CELLS == 0
    gap = np.where(opens, cell, cell - np.r_[0, cell[:-1]])
    both = np.empty(2 * len(keys), dtype=np.uint64)
    both[0::2] = gap.astype(np.uint64)
    both[1::2] = ((weights << 1) ^ (weights >> 63)).view(np.uint64)
    data, begins = packed(both)
    rows = np.flatnonzero(opens)
    cuts = np.r_[begins[2 * rows], len(data)]
    return group[rows], [zlib.compress(data[a:b].tobytes(), 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = unpacked(np.frombuffer(zlib.decompress(blob), dtype=np.uint8))
    sign = both[1::2]
    return np.cumsum(both[0::2].astype(np.int64)), (sign >> np.uint64(1)).view(np.int64) ^ -(sign & np.uint64(1)).view(np.int64)


class _Keys:
    """Numbers for the groups that a task meets."""

    def __init__(self, n: int) -> None:
        self.n, self.of, self.all = n, {}, []

    def numbers(self, rows: pa.RecordBatch) -> np.ndarray:
        """The group number of each row."""
        code = np.zeros(rows.num_rows, dtype=np.int64)
        for i in range(self.n):
            column = rows.column(i).dictionary_encode()
            code = code * (len(column.dictionary) + 1) + np.asarray(column.indices.fill_null(len(column.dictionary)))
            _, code = np.unique(code, return_inverse=True)
        _, at, code = np.unique(code, return_index=True, return_inverse=True)
        found = zip(*(rows.column(i).take(pa.array(at)).to_pylist() for i in range(self.n)), strict=True)
        return np.array([self.number(key) for key in found], dtype=np.int64)[code]

    def number(self, key: tuple) -> int:
        if key not in self.of:
            self.of[key] = len(self.all)
            self.all.append(key)
        return self.of[key]


def key_schema(df: DataFrame, keys: list[str], rest: list[tuple[str, pa.DataType]]) -> tuple[pa.Schema, str]:
    ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return pa.schema([*((k, to_arrow_type(df.schema[k].dataType)) for k in keys), *rest]), ddl


def rows_of(schema: pa.Schema, keys: list[tuple], columns: list) -> pa.RecordBatch:
    n = len(schema) - len(columns)
    arrays = [pa.array([k[i] for k in keys], type=schema.field(i).type) for i in range(n)]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, type=schema.field(n + i).type) for i, c in enumerate(columns))], schema=schema)


def sketch_rows(schema: pa.Schema, names: list[tuple], keys: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    group, blobs = encoded(keys, weights)
    for at in range(0, len(blobs), 2000):
        yield rows_of(schema, [names[g] for g in group[at : at + 2000]], [blobs[at : at + 2000]])


def spread_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A scan of few files gets a partition for each core, and equal values of a group go to the same, so that they
    are counted before they are sketched; a wide scan stays as it is. A hot group goes to several partitions."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores, *keys, F.pmod(F.hash("value"), F.lit(cores)))


def sketch(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Rows (keys, cells) that add up to one sketch per group, built by each task from what it scans."""
    plain = df.select(*keys, (F.col(value).cast("long") + F.lit(OFFSET)).alias("value"), (weight if weight is not None else F.lit(1)).cast("long").alias("weight")).where("value is not null and weight is not null")
    n = len(keys)
    schema, ddl = key_schema(plain, keys, [("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _Keys(n), [], 0

        def counted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((v, g))
            g, v, w = g[order], v[order], w[order]
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
            return g[starts], v[starts], np.add.reduceat(w, starts)

        def given() -> Iterator[pa.RecordBatch]:
            g, v, w = counted()
            at = 0
            while at < len(g):  # whole groups together, as far as they fit
                end = min(at + AT_ONCE, len(g))
                if end < len(g) and (back := int(np.searchsorted(g, g[end], "left"))) > at:
                    end = back
                yield from sketch_rows(schema, known.all, *cells_of(g[at:end], v[at:end], w[at:end]))
                at = end

        for rows in batches:
            if not rows.num_rows:
                continue
            held.append((known.numbers(rows), np.asarray(rows.column(n)), np.asarray(rows.column(n + 1))))
            size += rows.num_rows
            if size > HELD:
                held = [counted()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from given()
                    known, held, size = _Keys(n), [], 0
        if held:
            yield from given()

    return spread_by(plain, keys).mapInArrow(run, f"{ddl}, cells binary")


def added(batches: Iterator[pa.RecordBatch], n: int, whole: bool) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """(group names, keys, weights) of sketch rows, added up as far as a task may hold them. With ``whole`` the
    rows come sorted by group, and none is given before its last row."""
    known, keys, weights, size = _Keys(n), [], [], 0

    def total() -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate(keys), np.concatenate(weights))

    for rows in batches:
        if not rows.num_rows:
            continue
        numbers, last = known.numbers(rows), None
        ordered = np.argsort(numbers, kind="stable") if not whole else np.arange(len(numbers))
        for i in ordered:
            if size > ADDED and numbers[i] != last:
                k, w = total()
                if whole:  # all groups but the one that goes on; later ones of this batch hold nothing yet
                    done = (k >> CELL_BITS) != numbers[i]
                    yield known.all, k[done], w[done]
                    k, w = k[~done], w[~done]
                elif len(k) > ADDED // 2:
                    yield known.all, k, w
                    k, w = k[:0], w[:0]
                keys, weights, size = [k], [w], len(k)
            cell, weight = decoded(rows.column(n)[int(i)].as_py())
            keys.append((np.int64(numbers[i]) << CELL_BITS) + cell)
            weights.append(weight)
            size, last = size + len(cell), numbers[i]
            if size > 2 * ADDED:  # one group alone: its cells are bounded
                k, w = total()
                keys, weights, size = [k], [w], len(k)
    if keys:
        yield known.all, *total()


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same sketches in fewer rows: each task adds up what it has, without an exchange."""
    n = len(keys)
    schema, ddl = key_schema(sketches, keys, [("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, k, w in added(batches, n, False):
            yield from sketch_rows(schema, names, k, w)

    return sketches.select(*keys, "cells").mapInArrow(run, f"{ddl}, cells binary")


def together(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group in one partition. The rows of very many partitions meet in bundles first."""
    wide = sketches.rdd.getNumPartitions()
    bundles = math.isqrt(wide)
    few = sketches.select(*keys, "cells")
    if bundles > 16:
        few = merged(few.repartition(*keys, F.pmod(F.spark_partition_id(), F.lit(bundles))), keys)
    return few.repartition(*keys)


def rolled_up(sketches: DataFrame, keys: list[str], over: list[str]) -> DataFrame:
    """Rows (whole, over, keys, cells): the sketches as they are, and, where ``whole`` is true and ``over`` null,
    those merged over ``over`` (days), which each task adds up from what it has."""
    n, schema_keys = len(over), ["whole", *over, *keys]
    marked = sketches.select(F.lit(False).alias("whole"), *over, *keys, "cells")
    schema, ddl = key_schema(marked, schema_keys, [("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays(rows.columns, schema=schema)
            few = pa.RecordBatch.from_arrays(rows.columns[1 + n :], names=[*keys, "cells"])
            for names, k, w in added(iter([few]), len(keys), False):
                yield from sketch_rows(schema, [(True, *[None] * n, *name) for name in names], k, w)

    return marked.mapInArrow(run, f"{ddl}, cells binary")


def percentiles(sketches: DataFrame, keys: list[str], percents: tuple = PERCENTS) -> DataFrame:
    """(keys, percent, value, n) of every group."""
    n = len(keys)
    schema, ddl = key_schema(sketches, keys, [("percent", pa.float64()), ("value", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, k, w in added(batches, n, True):
            present, inverse = np.unique(k >> CELL_BITS, return_inverse=True)
            total, value = invert((inverse.astype(np.int64) << CELL_BITS) + (k & ((1 << CELL_BITS) - 1)), w, len(present), percents)
            for at in range(0, len(present), 10_000):
                some = [i for i in range(at, min(at + 10_000, len(present))) if total[i] > 0]
                each = np.repeat(some, len(percents)).astype(np.int64)
                yield rows_of(schema, [names[present[i]] for i in each], [np.tile(np.array(percents, dtype=np.float64), len(some)), value[some].reshape(-1), total[each]])

    return together(sketches, keys).sortWithinPartitions(*keys).mapInArrow(run, f"{ddl}, percent double, value long, n long")


KEYS = ["node", "status"]


def p3_percentiles(spark, sf_dir: str) -> DataFrame:
    """Median and other percentiles of ``ms`` per node and status, for each day of ``created_at`` and for the
    whole period (``day`` is null). The period's come from the days' sketches, not from the rows again; rows
    without a time have no day and count in the period only, as a sketch of their own."""
    logs = table(spark, sf_dir, "node_logs").withColumn("day", F.to_date("created_at"))
    both = rolled_up(sketch(logs, ["day", *KEYS], "ms"), KEYS, ["day"])
    return percentiles(both, ["whole", "day", *KEYS]).where("whole or day is not null").drop("whole")


def p3_whole_period(spark, sf_dir: str) -> DataFrame:
    """The whole period's percentiles from one sketch of all rows."""
    return percentiles(sketch(table(spark, sf_dir, "node_logs"), KEYS, "ms"), KEYS)


def p3_without_repeats(spark, sf_dir: str) -> DataFrame:
    """Rows delivered twice taken out of the finished sketch again, by adding their negative."""
    logs = table(spark, sf_dir, "node_logs")
    same = ["run_id", "repo", "path", "commit", "node", "status", "ms", "note", "created_at"]
    extra = logs.groupBy(*same).agg((F.count("*") - 1).alias("extra")).where("extra > 0")
    return percentiles(sketch(logs, KEYS, "ms").unionByName(sketch(extra, KEYS, "ms", -F.col("extra"))), KEYS)


QUERIES = {"p3_percentiles": p3_percentiles, "p3_whole_period": p3_whole_period, "p3_without_repeats": p3_without_repeats}
SQL: dict[str, str] = {}
