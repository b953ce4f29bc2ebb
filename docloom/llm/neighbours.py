"""The k most similar vectors of every vector, by a block matrix join with quantised pruning.

Vectors are spread over blocks of bounded size and every unordered pair of blocks is one tile. A tile
multiplies int8 vectors: their products are whole numbers below 2**24, which a single-precision product
holds exactly; it is scaled afterwards, and a bound of the quantisation error made of both vectors'
residuals is added. Only pairs whose upper bound reaches a floor of either vector survive; they are
recomputed in double precision within the tile, each vector keeps its best k of the tile, and the tiles'
lists are merged to the best k by a window with a limit per group (a sort, where a heap would do as well).
Blocks carry the float vectors, as crowded regions survive in numbers that only the recomputing there cuts. The floors are the k-th best similarity of each vector to a
sample of bounded size, hence never above its true k-th best: pruning loses nothing, the result is exact.

Equal vectors would tie in large groups: of each group only the first k + 1 by id take part (ties go to the
smaller id, so no other can be in a list), and all further members take over the list of the first one.

Defined cases: rows without an id, null vectors, vectors of another dimension, with null or not finite parts, or of all zeros
are left out; fewer than k other vectors give shorter lists; ties go to the smaller id; repeated rows are
vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import checkpointed, table

K = 5
DIMENSION = 64
#: Most vectors of a block: 8 bytes of ids, 256 of parts, 8 of the floor each, so below 10 MB a block. A vector
#: goes to as many tiles as there are blocks, so blocks are as large as that and the cores' number allow.
BLOCK = 32_768
#: Vectors that the floors are taken from; broadcast, 264 bytes each.
SAMPLE = 8192
#: Rows of a tile that are compared at once.
STRIP = 1024
SLACK = 1e-5


def sound(df: DataFrame, key: str, vector: str, dimension: int = DIMENSION) -> DataFrame:
    """(id, v) of the vectors that can be compared."""
    v = F.col(vector)
    fine = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(3e38))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), v.cast("array<float>").alias("v")).where(F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull())


def matrix(column: pa.ListArray) -> np.ndarray:
    offsets = column.offsets
    return np.asarray(column.values)[offsets[0].as_py() : offsets[-1].as_py()].reshape(len(column), -1)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors of unit length, their scales, and the lengths of what they miss."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    missed = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q.astype(np.int8), scale.astype(np.float32), missed.astype(np.float32)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def best(owner: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k best: greatest cosine first, then smallest id."""
    order = np.lexsort((other, -cosine, owner))
    o = owner[order]
    first = np.searchsorted(o, o, side="left")
    return order[np.arange(len(o)) - first < k]


def floors_of(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A value that each vector's k-th best similarity is known to reach."""
    unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    out = np.full(len(ids), -2.0)
    for at in range(0, len(ids), STRIP):
        s = unit[at : at + STRIP] @ sample.T
        s[ids[at : at + STRIP, None] == sample_ids[None, :]] = -2
        if s.shape[1] >= k:
            out[at : at + STRIP] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - SLACK
    return out


def tile(ids_a: np.ndarray, a: np.ndarray, floor_a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, floor_b: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, other, cosine): the best k of the tile for each vector of both blocks."""
    qa, sa, ma = quantised(a)
    qb, sb, mb = quantised(b)
    low_b = (floor_b - SLACK).astype(np.float32)
    qb = np.ascontiguousarray(qb.astype(np.float32).T)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(a), STRIP):
        upper = qa[at : at + STRIP].astype(np.float32) @ qb  # exact
        upper *= sb[None, :]
        upper *= sa[at : at + STRIP, None]
        upper += (ma[at : at + STRIP] * (1 + mb.max(initial=0)))[:, None]
        upper += mb[None, :]
        low_a = (floor_a[at : at + STRIP] - SLACK).astype(np.float32)
        hit = upper >= low_a[:, None]
        if not same:
            hit |= upper >= low_b[None, :]
        i, j = np.nonzero(hit)
        i += at
        if same:
            other = ids_a[i] != ids_b[j]
            i, j = i[other], j[other]
        for s in range(0, len(i), 1 << 18):  # recomputed in stretches of bounded size
            ii, jj = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            c = cosines(a[ii], b[jj])
            keep = c >= floor_a[ii] - SLACK
            own = (ids_a[ii][keep], ids_b[jj][keep], c[keep])
            chosen = best(*own, k)
            parts.append(tuple(x[chosen] for x in own))
            if not same:
                keep = c >= floor_b[jj] - SLACK
                own = (ids_b[jj][keep], ids_a[ii][keep], c[keep])
                chosen = best(*own, k)
                parts.append(tuple(x[chosen] for x in own))
    if not parts:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([])
    owner, other, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    chosen = best(owner, other, c, k)
    return owner[chosen], other[chosen], c[chosen]


def nearest(df: DataFrame, key: str, vector: str, k: int = K, dimension: int = DIMENSION, block: int = BLOCK, sample_size: int = SAMPLE) -> DataFrame:
    """(id, other, cosine, rank) for every sound vector."""
    spark = df.sparkSession
    vectors = sound(df, key, vector, dimension)
    # the first k + 1 of each group of equal vectors, found with a limit per group before the exchange
    ranked = vectors.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1).drop("place")
    size = vectors.count()
    if not size:
        return spark.createDataFrame([], "id long, other long, cosine double, rank int")
    # at least two tiles a core, so that all cores have work
    blocks = max(-(-size // block), min(-(-size // 512), math.isqrt(4 * spark.sparkContext.defaultParallelism)))
    taken = ranked.orderBy(F.xxhash64("id")).limit(sample_size).select("id", "v").collect()
    sample_x = np.array([r["v"] for r in taken], dtype=np.float64)
    sample_x = (sample_x / np.linalg.norm(sample_x, axis=1)[:, None]).astype(np.float32)
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in taken]), sample_x))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = np.asarray(rows.column(0))
            out = floors_of(ids, matrix(rows.column(1)).astype(np.float64), *shared.value, k)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out)], names=["id", "v", "floor"])

    packed = checkpointed(
        ranked.mapInArrow(floors, "id long, v array<float>, floor double")
        .groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
        .agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("parts"), F.collect_list("floor").alias("floors"))
    )
    # each block goes to the tiles it is part of; a tile's key is (smaller, greater block)
    left = packed.select(F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j"), F.struct("ids", "parts", "floors").alias("a"))
    right = packed.select(F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.struct("ids", "parts", "floors").alias("b"))
    tiles = left.join(right, ["i", "j"]).select("i", "j", "a", "b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for n in range(rows.num_rows):
                sides = []
                for c in (2, 3):
                    side = rows.column(c)
                    ids, parts, floor = (np.asarray(side.field(f)[n].values) for f in ("ids", "parts", "floors"))
                    sides += [ids, parts.reshape(len(ids), -1).astype(np.float64), floor]
                owner, other, cosine = tile(*sides, rows.column(0)[n].as_py() == rows.column(1)[n].as_py(), k)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(other), pa.array(cosine)], names=["id", "other", "cosine"])

    found = tiles.mapInArrow(multiply, "id long, other long, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    lists = checkpointed(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))  # used twice below
    return lists.unionByName(of_copies(vectors, lists, k))


def of_copies(vectors: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Lists of the members of large groups of equal vectors beyond the first k + 1: the first one's list with
    itself in it. Their similarity to the first one is that of equal vectors."""
    crowd = vectors.groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > k + 1)
    # ids beyond the first k + 1 of a group; where there is none, nothing is joined further
    member = vectors.join(crowd, "v").select("id", "first", "v", "n")
    known = lists.select("id").distinct()
    extra = member.join(known, "id", "left_anti").select("id", "first")
    firsts = lists.join(crowd.select(F.col("first").alias("id")), "id", "left_semi")
    one = F.lit(1.0)
    candidates = firsts.select(F.col("id").alias("first"), "other", "cosine").unionByName(firsts.select(F.col("id").alias("first"), F.col("id").alias("other"), one.alias("cosine")).distinct())
    best_of = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("first").orderBy(F.desc(F.round("cosine", 12)), "other"))).where(F.col("rank") <= k)
    return extra.join(best_of, "first").select("id", "other", "cosine", "rank")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Unordered pairs in which one is among the five nearest of the other."""
    near = nearest(table(spark, sf_dir, "vector_points"), "vec_id", "embedding")
    return near.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def p5_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ranked lists of the ``embeddings`` table."""
    near = nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return near.select(F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), "other", F.round("cosine", 6).alias("cosine"))


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
SQL: dict[str, str] = {
    "p5_found": """
WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM vector_points WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
     n AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS r FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM n WHERE r <= 5""",
    "p5_neighbours": """
WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64),
     n AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS c FROM p a JOIN p b ON a.vec_id <> b.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) AS rank FROM n)
SELECT vec_id, rank, other, round(c, 6) AS cosine FROM r WHERE rank <= 5""",
}
