"""Near-duplicate records by T-occurrence search over inverted lists.

Two records are linked when their distinct words overlap by at least the threshold (Jaccard). A partner
of a record of n words must then occur in at least T = ceil(threshold * n) of its n inverted lists. As in
DivideSkip the lists are divided: the T - C longest are set aside, so every partner still occurs C times
in the short ones. The short lists are merged by joining postings and counting occurrences per pair; the
long ones are never merged, only probed: of each pair that reached C the smaller record's words are looked
up in the other's sorted words by binary search, and pairs that reach the required overlap are kept. (A
long list holds a record exactly if the record's words hold its word; the latter is the shorter of the two
sorted lists.) Both sides divide their lists in one global order (list length, then word), which makes the
merge of short lists complete.

List lengths come from all classes of records, counted in a table of fixed size (``BUCKETS`` hash buckets), so what is
broadcast does not grow with the data. Records with the same words form one class, and classes are joined,
so a statement stored a million times costs one record. A list of more than ``SPLIT`` postings that
records need after all is split: one side's postings go to one part each, the other's to all parts. Texts
are read and cut into words once. Nothing is capped.

Words are compared by 32-bit hashes; two different words of a pair collide with a chance below 1e-6.

Defined cases: records without an id are left out; null and empty texts and records below ``min_words`` distinct words are linked to nothing
(they are in no class; a null text counts as no words); repeated rows
are linked to each other; the empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import checkpointed, table, written

BUCKETS = 1 << 16
#: Occurrences that a partner must reach in the short lists alone.
C = 2
PER_MILLE = 700
#: Postings of one word that meet in one part of a join.
SPLIT = 20_000


def words_of(text: str):
    """Distinct words: maximal runs of letters and digits, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def records(df: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(id, words, k) of the records with enough words: sorted hashes of the distinct words, and 96 bits that
    stand for the set. Written once; everything else starts from it."""
    cut = df.select(F.col(key).cast("long").alias("id"), words_of(text).alias("w")).where("id is not null").where(F.size("w") >= min_words)
    hashed = cut.select("id", F.array_sort(F.transform("w", lambda w: F.hash(w))).alias("words"))
    return written(hashed.withColumn("k", F.struct(F.xxhash64("words").alias("a"), F.hash("words").alias("b"))))


def classes(recs: DataFrame) -> DataFrame:
    """(k, class_id, words): the smallest id of each set of words."""
    return recs.groupBy("k").agg(F.min("id").alias("class_id"), F.first("words").alias("words"))


def list_lengths(cls: DataFrame) -> np.ndarray:
    """Upper bounds of the inverted lists' lengths, per hash bucket; ``BUCKETS`` numbers whatever the data."""
    counted = cls.select(F.explode("words").alias("w")).groupBy(F.pmod("w", F.lit(BUCKETS)).alias("b")).count().collect()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in counted:
        out[row["b"]] = row["count"]
    return out


def short_lists(cls: DataFrame, lengths: np.ndarray, per_mille: int, c: int, split: int) -> DataFrame:
    """Postings (word, parts, class_id, size, bits) of each class in its short lists: its n - T + C rarest words.
    ``bits`` has one of 64 bits set for each word of the class; ``parts`` tells in how many the list is split."""
    shared = cls.sparkSession.sparkContext.broadcast(lengths)
    schema = pa.schema([("word", pa.int32()), ("parts", pa.int32()), ("class_id", pa.int64()), ("size", pa.int32()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = shared.value
        for rows in batches:
            lists = rows.column(1)
            offsets = np.asarray(lists.offsets)
            words = np.asarray(lists.values)[offsets[0] : offsets[-1]]
            sizes = np.diff(offsets).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            lists_ = length[np.mod(words.astype(np.int64), BUCKETS)]
            order = np.lexsort((words, lists_, owner))
            place = np.arange(len(words)) - np.repeat(offsets[:-1] - offsets[0], sizes)
            least = -(-sizes * per_mille // 1000)
            kept = place < np.repeat(np.minimum(sizes, sizes - least + c), sizes)
            if not len(words):
                continue
            bits = np.bitwise_or.reduceat(np.uint64(1) << (words.view(np.uint32) % np.uint32(64)).astype(np.uint64), offsets[:-1] - offsets[0]).view(np.int64)
            mine = owner[kept]
            parts = (lists_[order][kept] // split + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(words[order][kept], type=pa.int32()), pa.array(parts), pa.array(np.asarray(rows.column(0))[mine], type=pa.int64()), pa.array(sizes[mine].astype(np.int32)), pa.array(bits[mine])], schema=schema)

    return cls.select("class_id", "words").mapInArrow(run, "word int, parts int, class_id long, size int, bits long")


def linked_classes(cls: DataFrame, lengths: np.ndarray, per_mille: int = PER_MILLE, c: int = C, split: int = SPLIT) -> DataFrame:
    """(a, b), a < b: pairs of classes whose words overlap enough.

    A pair that meets in a short list is dropped at once if it cannot overlap enough: every bit in which two
    classes differ needs a word that only one of them has, so n + m less those bits is at least twice the overlap.
    """
    postings = short_lists(cls, lengths, per_mille, c, split)
    both = F.col("n") + F.col("m")
    can = (both - F.bit_count(F.col("x").bitwiseXOR(F.col("y")))) * (1000 + per_mille) >= both * 2 * per_mille

    def meet(lists: DataFrame, a: Column | None = None, b: Column | None = None) -> DataFrame:
        part = ["part"] if a is not None else []
        left = lists.select("word", *([a.alias("part")] if part else []), F.col("class_id").alias("a"), F.col("size").alias("n"), F.col("bits").alias("x"))
        right = lists.select("word", *([b.alias("part")] if part else []), F.col("class_id").alias("b"), F.col("size").alias("m"), F.col("bits").alias("y"))
        return left.join(right, ["word", *part]).where("a < b").where(can).select("a", "b", "n", "m")

    if (lengths > split).any():
        whole, long = postings.where("parts = 1"), postings.where("parts > 1")
        met = meet(whole).unionByName(meet(long, F.pmod(F.hash("class_id"), F.col("parts")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    else:  # no list is that long: one exchange serves both sides
        met = meet(postings)
    # a pair of sets of fewer than C required words may meet less often: all its lists are short then
    merged = met.groupBy("a", "b").agg(F.count("*").alias("met"), F.first("n").alias("n"), F.first("m").alias("m")).where(F.col("met") >= F.least(F.lit(c), F.ceil(F.greatest("n", "m") * per_mille / 1000)))
    words = cls.select("class_id", "words")
    probed = merged.select("a", "b").join(words.select(F.col("class_id").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("class_id").alias("b"), F.col("words").alias("wb")), "b")
    return probe(probed, per_mille)


def probe(candidates: DataFrame, per_mille: int) -> DataFrame:
    """(a, b) of the candidates (a, b, wa, wb) whose sorted words overlap enough. All words of a batch are probed
    at once: words carry their row's number in front, so all rows' lists together are sorted."""

    def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offsets = np.asarray(lists.offsets)
        sizes = np.diff(offsets).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return sizes, owner, (owner << 32) + (np.asarray(lists.values)[offsets[0] : offsets[-1]].astype(np.int64) + (1 << 31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n, owner_a, a = flat(rows.column(2))
            m, owner_b, b = flat(rows.column(3))
            smaller = n <= m
            needles = np.concatenate([a[smaller[owner_a]], b[~smaller[owner_b]]])
            common = np.zeros(len(n), dtype=np.int64)
            for wanted, held in ((needles[: int(n[smaller].sum())], b), (needles[int(n[smaller].sum()) :], a)):
                if len(wanted) and len(held):
                    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                    common += np.bincount((wanted >> 32)[held[at] == wanted], minlength=len(n))
            kept = pa.array(common * 1000 >= (n + m - common) * per_mille)
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(kept), rows.column(1).filter(kept)], names=["a", "b"])

    return candidates.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def classified(df: DataFrame, key: str, text: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(class_id, words) of each set of words, and (id, class_id) of all records with enough words."""
    recs = records(df, key, text, min_words)
    cls = written(classes(recs))
    return cls.select("class_id", "words"), recs.select("id", "k").join(cls.select("k", "class_id"), "k").select("id", "class_id")


def pairs(df: DataFrame, key: str, text: str, min_words: int, per_mille: int = PER_MILLE, split: int = SPLIT) -> DataFrame:
    """(id_a, id_b) of all linked records, copies included."""
    cls, held = classified(df, key, text, min_words)
    links = linked_classes(cls, list_lengths(cls), per_mille, split=split)
    left, right = held.select(F.col("class_id").alias("a"), F.col("id").alias("x")), held.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    across = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copied = held.groupBy("class_id").count().where("count > 1").select("class_id")
    twins = held.join(copied, "class_id")
    within = twins.select("class_id", F.col("id").alias("id_a")).join(twins.select("class_id", F.col("id").alias("id_b")), "class_id").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def groups(df: DataFrame, key: str, text: str, min_words: int, per_mille: int = PER_MILLE) -> DataFrame:
    """One row per record with enough words: its class, its number of linked classes, and its group, the
    smallest class reachable over links. Labels move along links and jump over each other's until none
    changes; each round is checkpointed in the shared folder."""
    cls, held = classified(df, key, text, min_words)
    links = checkpointed(linked_classes(cls, list_lengths(cls), per_mille))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("links")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        moved = labels.join(near, "a").select("a", "links", "label", F.least("label", "near").alias("better"))
        jump = labels.select(F.col("a").alias("better"), F.col("label").alias("further"))
        after = checkpointed(moved.join(jump, "better", "left").select("a", "links", F.least("better", F.coalesce("further", "better")).alias("label"), F.col("label").alias("was")))
        changed = after.where("label <> was").limit(1).count()
        labels = after.select("a", "links", "label")
        if not changed:
            break
    return held.join(labels.withColumnRenamed("a", "class_id"), "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("label", "class_id").alias("group_id"))


MIN_WORDS = 6


def p6_found(spark, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "claims"), "id", "claim", MIN_WORDS)


def p6_groups(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "claims"), "id", "claim", MIN_WORDS)


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
SQL: dict[str, str] = {
    # every pair of claims
    "p6_found": r"""
WITH c AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(claim), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM claims),
     k AS (SELECT id, w, len(w) AS n FROM c WHERE len(w) >= 6)
SELECT x.id AS id_a, y.id AS id_b FROM k x JOIN k y ON x.id < y.id AND x.n * 10 >= y.n * 7 AND y.n * 10 >= x.n * 7
WHERE len(list_intersect(x.w, y.w)) * 17 >= (x.n + y.n) * 7""",
}
