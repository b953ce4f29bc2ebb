import numpy as np
import pytest

from docloom.llm import neighbours as N


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {i: [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-round(s[n, j], 9), ids[j])) if j != n][:k] for n, i in enumerate(ids)}


@pytest.mark.parametrize(("block", "sample"), [(64, 16), (100, 400), (1000, 4)])
def test_against_brute_force(spark, block, sample):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(7, 64))
    x = (centres[rng.integers(0, 7, 400)] + rng.normal(size=(400, 64)) * rng.choice([0.02, 0.3, 1.0], size=(400, 1))) * rng.uniform(0.1, 9, size=(400, 1))
    x = x.astype(np.float32).astype(np.float64)
    x[50:62] = x[50]  # twelve equal vectors
    x[70] = x[71]
    ids = np.arange(400) * 3 + 1
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got: dict[int, list] = {}
    for r in sorted(N.nearest(df, "vec_id", "embedding", block=block, sample_size=sample).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append(r.other)
    assert got == brute(ids, x, 5)


def test_defined_cases(spark):
    one = [1.0] * 64
    rows = [(1, one, "a"), (2, None, "a"), (3, [0.0] * 64, "a"), (4, [1.0] * 8, "a"), (5, one[:-1] + [None], "a"), (6, one[:-1] + [float("nan")], "a"), (7, [2.0] + one[1:], None), (None, one, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, floor string")
    assert {(r.id, r.other, r["rank"]) for r in N.nearest(df, "vec_id", "embedding").collect()} == {(1, 7, 1), (7, 1, 1)}
    assert N.nearest(df.limit(0), "vec_id", "embedding").count() == 0


def test_bound_of_quantised_products():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(60, 64)) * 7
    (qx, sx, mx), (qy, sy, my) = N.quantised(x), N.quantised(y)
    assert qx.dtype == qy.dtype == np.int8
    whole = qx.astype(np.float32) @ qy.astype(np.float32).T
    assert (whole == qx.astype(np.int64) @ qy.astype(np.int64).T).all()
    approx = whole * sx[:, None] * sy[None, :]
    true = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    assert (np.abs(true - approx) <= mx[:, None] * (1 + my.max()) + my[None, :] + 1e-6).all() and np.abs(qx.astype(int)).max() <= 127
