import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import quantiles as Q


def worst(values, weights, percents):
    """The greatest rank error of one group's sketch, as a share of its weight."""
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    below = np.cumsum(weights)
    total, got = Q.invert(*Q.cells_of(np.zeros(len(values), dtype=np.int64), (values + Q.OFFSET).astype(np.uint64), weights), 1, percents)
    assert total[0] == below[-1]
    errors = []
    for percent, value in zip(percents, got[0], strict=True):
        wanted = max(1, np.ceil(total[0] * percent / 100))
        a, b = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
        low, high = (below[a - 1] if a else 0) + 1, below[b - 1] if b else 0
        errors.append(max(low - wanted, wanted - max(high, low - 1), 0) / total[0])
    return max(errors)


def heavy_ties(rng):
    values = np.unique(rng.integers(0, 10**6, 20_000))
    weights = np.ones(len(values), dtype=np.int64)
    weights[rng.choice(len(values), 60, replace=False)] = 10_000
    return values, weights


def few_and_far(rng):
    values = np.unique(rng.integers(-(2**31), 2**31, 64))
    return values, np.full(len(values), 1000)


def some_light(rng):
    values = np.unique(np.r_[rng.integers(0, 10**5, 1500), rng.integers(0, 10**5, 60)])
    return values, np.where(rng.random(len(values)) < 0.04, 5000, 1)


@pytest.mark.parametrize("shape", [heavy_ties, few_and_far, some_light])
def test_stated_rank_error(shape):
    percents = tuple(range(1, 100, 3))
    for seed in range(25):
        assert worst(*shape(np.random.default_rng(seed)), percents) <= Q.RANK_ERROR, seed


def ranks(values, value):
    """The ranks that a value holds among sorted ones."""
    return np.searchsorted(values, value, "left") + 1, np.searchsorted(values, value, "right")


def test_rank_error_of_groups(spark):
    rng = np.random.default_rng(5)
    groups = {"heavy": np.concatenate([rng.lognormal(6, 2, 40_000).astype(int), np.full(15_000, 120_001), np.array([-5, 2**31 - 1, -(2**31)])]), "flat": rng.integers(0, 10**6, 30_000), "few": np.array([1, 1, 2])}
    rows = [(g, int(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, ms int").repartition(5)
    got = Q.percentiles(Q.sketch(df, ["g"], "ms"), ["g"], (1, 25, 50, 90, 95, 99)).collect()
    assert len(got) == 18
    for r in got:
        values = np.sort(groups[r.g])
        low, high = ranks(values, r.value)
        wanted = np.ceil(len(values) * r.percent / 100)
        assert max(low - wanted, wanted - max(high, low - 1), 0) <= Q.RANK_ERROR * len(values) + 1, r
        assert r.n == len(values)


def test_cells_survive_packing():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 3 << Q.CELL_BITS, 30_000))
    weights = rng.integers(-(2**62), 2**62, len(keys))
    weights[:3] = [1, -1, 2**40]
    group, blobs = Q.encoded(keys, weights)
    back = [Q.decoded(b) for b in blobs]
    assert (np.concatenate([(g << Q.CELL_BITS) + c for g, (c, _) in zip(group, back, strict=True)]) == keys).all()
    assert (np.concatenate([w for _, w in back]) == weights).all() and max(len(c) for c, _ in back) <= Q.ROW_CELLS


def test_tasks_that_hold_little(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(g), int(v)) for g, v in zip(rng.integers(0, 40, 30_000), rng.integers(0, 5000, 30_000), strict=True)]
    df = spark.createDataFrame(rows, "g int, ms int").repartition(3)
    batches = Q.sketch(df, ["g"], "ms").orderBy("g").toArrow().to_batches(max_chunksize=7)

    def given(whole):
        """Cells by group, and how often each group is given."""
        cells, times = {}, {}
        for names, k, w in Q.added(iter(batches), 1, whole):
            for g in np.unique(k >> Q.CELL_BITS):
                times[names[g]] = times.get(names[g], 0) + 1
            for g, c, x in zip(k >> Q.CELL_BITS, k & ((1 << Q.CELL_BITS) - 1), w, strict=True):
                cells[names[g], c] = cells.get((names[g], c), 0) + x
        return {c: x for c, x in cells.items() if x}, times

    want, _ = given(True)
    monkeypatch.setattr(Q, "ADDED", 3000)
    cells, times = given(True)
    assert cells == want and set(times.values()) == {1} and len(times) == 40
    cells, times = given(False)
    assert cells == want and max(times.values()) > 1


def test_merging_and_deleting(spark):
    rng = np.random.default_rng(6)
    rows = [(int(d), int(v)) for d, v in zip(rng.integers(0, 9, 20_000), rng.integers(0, 50_000, 20_000), strict=True)]
    df = spark.createDataFrame(rows, "day int, ms int").withColumn("g", F.lit("x"))
    whole = Q.percentiles(Q.sketch(df, ["g"], "ms"), ["g"]).collect()
    both = Q.percentiles(Q.rolled_up(Q.sketch(df, ["day", "g"], "ms"), ["g"], ["day"]), ["whole", "day", "g"])
    assert sorted(whole) == sorted(both.where("whole").select("g", "percent", "value", "n").collect())
    assert both.where("not whole").count() == 9 * 4
    wide = Q.percentiles(Q.sketch(df.repartition(400), ["g"], "ms"), ["g"]).collect()  # bundles first
    assert sorted(whole) == sorted(wide)
    extra = spark.createDataFrame([("x", 7)] * 5000, "g string, ms int")
    both = Q.sketch(df.select("g", "ms").unionByName(extra), ["g"], "ms")
    assert sorted(Q.percentiles(both.unionByName(Q.sketch(extra, ["g"], "ms", F.lit(-1))), ["g"]).collect()) == sorted(whole)


def test_defined_cases(spark):
    rows = [("a", None, 1, "x"), ("a", None, None, "x"), (None, "s", 5, None), (None, "s", 5, None), (None, None, None, "x")]
    df = spark.createDataFrame(rows, "node string, status string, ms int, cells string")
    got = {(r.node, r.status): (r.value, r.n) for r in Q.percentiles(Q.sketch(df, ["node", "status"], "ms"), ["node", "status"], (50,)).collect()}
    assert got == {("a", None): (1, 1), (None, "s"): (5, 2)}
    assert Q.percentiles(Q.sketch(df.limit(0), ["node"], "ms"), ["node"]).count() == 0
    gone = Q.sketch(df, ["node"], "ms").unionByName(Q.sketch(df, ["node"], "ms", F.lit(-1)))
    assert Q.percentiles(gone, ["node"]).count() == 0
