"""Vector retrieval under filters, floors and budgets.

Queries are a stated set (every id divisible by 20), but for ``page_similarity``, which asks all chunks. Queries and stored
vectors are packed in blocks of bounded size, and blocks of the same group meet by a join; each pair of blocks
is one product and keeps the best k per query, and these short lists are merged. Nothing comes to the driver or is paired that does not share the filter's keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.embed import slots
from docloom.session import table

DIMENSION = 64
#: Vectors of a block, 264 bytes each, and the parts that a group's stored blocks are spread over.
QUERY_BLOCK, STORED_BLOCK, PARTS = 512, 4096, 8
PACK = 512


def usable(points: DataFrame) -> DataFrame:
    """Points with a vector of the right dimension that is not all zeros."""
    fine = (F.size("embedding") == DIMENSION) & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    return points.where(F.coalesce(fine, F.lit(False)))


def search(points: DataFrame, queries: DataFrame, k: int, same: list[str], skip_self: bool = True) -> DataFrame:
    """(query_id, vec_id, score): the k best points per query by cosine among those equal in the ``same``
    columns; ties go to the smaller id. Rows with a null in ``same`` meet nothing."""
    met = " and ".join(f"`{c}` is not null" for c in same) or "true"
    group = F.concat_ws("\u0000", *same) if same else F.lit("")
    side = lambda df: usable(df).where(met).select(group.alias("g"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # a stored block meets each query block of its group; query blocks go to all of the group's parts
    stored, asked_ = packed(side(points), "g", "s", STORED_BLOCK), packed(side(queries), "g", "q", QUERY_BLOCK)
    pairs = stored.withColumn("part", F.pmod(F.hash(F.get("s_ids", F.lit(0))), F.lit(PARTS))).join(asked_.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["g", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, q_ids = (np.asarray(b.column(c)[i].values) for c in (0, 2))
                x, q = (unit(np.asarray(b.column(c)[i].values).astype(np.float64).reshape(-1, DIMENSION)) for c in (1, 3))
                score = q @ x.T
                if skip_self:
                    score[q_ids[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, axis=1)
                q_at, c_at = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q_at]), pa.array(ids[order[q_at, c_at]]), pa.array(best[q_at, c_at])], names=["query_id", "vec_id", "score"])

    found = pairs.select("s_ids", "s_x", "q_ids", "q_x").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def asked(points: DataFrame) -> DataFrame:
    """The query set: every row whose id is divisible by 20."""
    return points.where("vec_id % 20 = 0")


def nearest_filtered(spark, sf_dir: str) -> DataFrame:
    """The five nearest points of the same repository for each query."""
    points = table(spark, sf_dir, "vector_points")
    return search(points, asked(points), 5, ["repo"]).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def nearest_embeddings(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows for each query of the embeddings table."""
    points = table(spark, sf_dir, "embeddings")
    return search(points, asked(points), 5, []).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def best_per_point(spark, sf_dir: str, k: int = 10, floor: float = 0.1) -> DataFrame:
    """Several queries of one request: 2k hits per query first, then the floor, the best score per point, and
    the k best points. A request is the queries of one repository."""
    points = table(spark, sf_dir, "vector_points")
    hits = search(points, asked(points), 2 * k, ["repo"]).where(F.col("score") >= floor)
    request = points.select(F.col("vec_id").alias("query_id"), F.col("repo").alias("request"))
    best = hits.join(request, "query_id").groupBy("request", "vec_id").agg(F.round(F.max("score"), 6).alias("score"))
    order = Window.partitionBy("request").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def priority_merge(spark, sf_dir: str, k: int = 8) -> DataFrame:
    """Hits of the same kind first, then those of the same repository, each point once, k per query: order of
    the sources counts before score."""
    points = table(spark, sf_dir, "vector_points")
    first = search(points, asked(points), 5, ["repo", "kind"]).withColumn("source", F.lit(1))
    second = search(points, asked(points), 5, ["repo"]).withColumn("source", F.lit(2))
    once = first.unionByName(second).groupBy("query_id", "vec_id").agg(F.min(F.struct("source", "rank")).alias("p"))
    order = Window.partitionBy("query_id").orderBy("p.source", "p.rank")
    return once.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).select("query_id", "place", "vec_id")


def semantic_hits(spark, sf_dir: str, k: int = 6, floor: float = 0.2) -> DataFrame:
    """The k best points per query that reach the floor, briefs whatever they reach; the floor comes after the
    2k best were taken, so it can leave fewer."""
    points = table(spark, sf_dir, "vector_points")
    kinds = points.select("vec_id", "kind")
    hits = search(points, asked(points), 2 * k, ["repo"]).join(kinds, "vec_id").where((F.col("kind") == "brief") | (F.col("score") >= floor))
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).select("query_id", "place", "vec_id")


def code_context(spark, sf_dir: str, k: int = 6, reach: int = 20, per_path: int = 2) -> DataFrame:
    """Context of each query: of its ``reach`` best points those of other paths, at most ``per_path`` of a path, the
    first ``k``."""
    points = table(spark, sf_dir, "vector_points")
    paths = points.select(F.col("vec_id").cast("long").alias("vec_id"), "path")
    hits = search(points, asked(points), reach, ["repo"]).join(paths, "vec_id").join(paths.select(F.col("vec_id").alias("query_id"), F.col("path").alias("own")), "query_id").where("not (path <=> own)")
    few = hits.withColumn("p", F.row_number().over(Window.partitionBy("query_id", "path").orderBy("rank"))).where(F.col("p") <= per_path)
    order = Window.partitionBy("query_id").orderBy("rank")
    return few.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).select("query_id", "place", "vec_id")


def chunk_similarity(spark, sf_dir: str) -> DataFrame:
    """Per page of the query set: the least, over its chunks in the set, of the greatest similarity to an approved chunk of
    the repository; 0 where there is none. High values mark pages that say nothing new."""
    points = table(spark, sf_dir, "vector_points")
    asked_ = asked(usable(points)).where("kind <> 'approved'")
    best = search(points.where("kind = 'approved'"), asked_, 1, ["repo"]).select("query_id", "score")
    pages = asked_.select(F.col("vec_id").alias("query_id"), "repo", "path")
    return pages.join(best, "query_id", "left").groupBy("repo", "path").agg(F.round(F.min(F.coalesce("score", F.lit(0.0))), 6).alias("similarity"))


def packed(points: DataFrame, key: str, name: str, size: int = PACK) -> DataFrame:
    """(key, ids, numbers): vectors of a group in blocks of about ``size``, so that a large one is many rows."""
    sizes = points.groupBy(key).agg(F.ceil(F.count("*") / size).alias("blocks"))
    rows = points.join(sizes, key).groupBy(key, F.pmod(F.xxhash64("vec_id"), "blocks").alias("block")).agg(F.collect_list(F.struct(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("e"))).alias("rows"))
    return rows.select(key, F.col("rows.vec_id").alias(f"{name}_ids"), F.flatten("rows.e").alias(f"{name}_x"))


def most_similar(asked_: DataFrame, stored: DataFrame) -> DataFrame:
    """(query_id, score): the greatest cosine of each query to a stored vector of its repository. Blocks meet
    blocks by a join on the repository; nothing comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, (q, x) = np.asarray(b.column(0)[i].values), (unit(np.asarray(b.column(j)[i].values).astype(np.float64).reshape(-1, DIMENSION)) for j in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((q @ x.T).max(axis=1))], names=["query_id", "score"])

    met = packed(asked_, "repo", "q").join(packed(stored, "repo", "s").drop("s_ids"), "repo").select("q_ids", "q_x", "s_x")
    return met.mapInArrow(run, "query_id long, score double").groupBy("query_id").agg(F.max("score").alias("score"))


def page_similarity(spark, sf_dir: str) -> DataFrame:
    """Per page: the least, over all its chunks, of the greatest similarity to an approved chunk of the
    repository; 0 where there is none. High values mark pages that say nothing new."""
    points = usable(table(spark, sf_dir, "vector_points"))
    asked_ = points.where("kind <> 'approved'")
    best = most_similar(asked_.where("repo is not null"), points.where("kind = 'approved' and repo is not null"))
    pages = asked_.select(F.col("vec_id").cast("long").alias("query_id"), "repo", "path")
    return pages.join(best, "query_id", "left").groupBy("repo", "path").agg(F.round(F.min(F.coalesce("score", F.lit(0.0))), 6).alias("similarity"))


def budget_prefix(spark, sf_dir: str, budget: int = 30_000) -> DataFrame:
    """Documents per repository, newest first, until the next would exceed the budget of characters. Each
    kept text has at least one character, so no more than ``budget`` rows of a repository can be kept: only so
    many reach the running sum, which keeps a hot repository's window bounded and loses nothing."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 0 and repo is not null").select("repo", "doc_id", "updated_at", "n_chars")
    order = Window.partitionBy("repo").orderBy(F.col("updated_at").desc_nulls_last(), "doc_id")
    near = docs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget)
    running = F.sum("n_chars").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return near.withColumn("chars", running).where(F.col("chars") <= budget).select("repo", "doc_id", "chars")


def word_vectors(spark, sf_dir: str) -> DataFrame:
    """Non-zero parts of each document's deterministic word-count vector."""
    return slots(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text").select("doc_id", F.col("slot").cast("long").alias("slot"), "n")


QUERIES = {f.__name__: f for f in (nearest_filtered, nearest_embeddings, best_per_point, semantic_hits, code_context, priority_merge, chunk_similarity, page_similarity, budget_prefix, word_vectors)}
_P = "p AS (SELECT vec_id, repo, path, kind, CAST(embedding AS DOUBLE[]) AS e FROM vector_points WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0)"


def _hits(name: str, k: int, same: str, extra: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, b.vec_id, list_cosine_similarity(q.e, b.e) AS score FROM p q JOIN p b ON {same} WHERE q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id AND {extra})) WHERE rank <= {k})"


SQL = {
    "nearest_filtered": f"WITH {_P}, {_hits('h', 5, 'q.repo = b.repo')} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM h",
    "nearest_embeddings": f"WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), {_hits('h', 5, 'true')} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM h",
    "best_per_point": f"WITH {_P}, {_hits('h', 20, 'q.repo = b.repo')}, b AS (SELECT v.repo AS request, h.vec_id, round(max(h.score), 6) AS score FROM h JOIN vector_points v ON v.vec_id = h.query_id WHERE h.score >= 0.1 GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, vec_id) AS rank FROM b) WHERE rank <= 10",
    "semantic_hits": f"WITH {_P}, {_hits('h', 12, 'q.repo = b.repo')} SELECT query_id, place, vec_id FROM (SELECT h.query_id, h.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM h JOIN vector_points v USING (vec_id) WHERE v.kind = 'brief' OR h.score >= 0.2) WHERE place <= 6",
    "code_context": f"WITH {_P}, {_hits('h', 20, 'q.repo = b.repo')}, x AS (SELECT h.query_id, h.vec_id, h.rank, row_number() OVER (PARTITION BY h.query_id, v.path ORDER BY h.rank) AS pp FROM h JOIN vector_points v ON v.vec_id = h.vec_id JOIN vector_points o ON o.vec_id = h.query_id WHERE v.path IS DISTINCT FROM o.path) SELECT query_id, place, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM x WHERE pp <= 2) WHERE place <= 6",
    "priority_merge": f"WITH {_P}, {_hits('a', 5, 'q.repo = b.repo AND q.kind = b.kind')}, {_hits('b2', 5, 'q.repo = b.repo')}, u AS (SELECT query_id, vec_id, min(s * 100 + rank) AS o FROM (SELECT 1 AS s, * FROM a UNION ALL SELECT 2 AS s, * FROM b2) GROUP BY 1, 2) SELECT query_id, place, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS place FROM u) WHERE place <= 8",
    "chunk_similarity": f"WITH {_P}, b AS (SELECT q.vec_id, q.repo, q.path, max(list_cosine_similarity(q.e, a.e)) AS s FROM p q LEFT JOIN p a ON a.repo = q.repo AND a.kind = 'approved' WHERE q.vec_id % 20 = 0 AND q.kind <> 'approved' GROUP BY 1, 2, 3) SELECT repo, path, round(min(coalesce(s, 0)), 6) AS similarity FROM b GROUP BY 1, 2",
    "page_similarity": f"WITH {_P}, b AS (SELECT q.vec_id, q.repo, q.path, max(list_cosine_similarity(q.e, a.e)) AS s FROM p q LEFT JOIN p a ON a.repo = q.repo AND a.kind = 'approved' WHERE q.kind <> 'approved' GROUP BY 1, 2, 3) SELECT repo, path, round(min(coalesce(s, 0)), 6) AS similarity FROM b GROUP BY 1, 2",
    "budget_prefix": "SELECT repo, doc_id, CAST(chars AS BIGINT) AS chars FROM (SELECT repo, doc_id, sum(n_chars) OVER (PARTITION BY repo ORDER BY updated_at DESC NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS chars FROM documents WHERE n_chars > 0 AND repo IS NOT NULL) WHERE chars <= 30000",
    "word_vectors": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS word FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2), d AS (SELECT word, list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(string_split(word, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 64) AS slot FROM (SELECT DISTINCT word FROM c)) SELECT doc_id, slot, CAST(sum(n) AS BIGINT) AS n FROM c JOIN d USING (word) GROUP BY 1, 2",
}
