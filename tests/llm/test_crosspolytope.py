import numpy as np
import pytest

from nodetide.llm import crosspolytope as C

RNG = np.random.default_rng(9)


def clustered(n, dim=64, spread=0.02):
    base = RNG.normal(size=(n // 8, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    return (base[RNG.integers(0, len(base), n)] + spread * RNG.normal(size=(n, dim)) * RNG.random((n, 1))).astype(np.float32)


def brute(rows, threshold=0.98):
    """(links, smallest id) by comparing everything."""
    n = len(rows)
    x = [None if r[1] is None or r[2] is None or any(v is None or not np.isfinite(v) for v in r[1]) or not any(r[1]) else np.array(r[1], float) for r in rows]
    hit = [[j for j in range(n) if j != i and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j])
            and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= threshold] for i in range(n)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in hit[i]:
                if root[j] < root[i]:
                    root[i], changed = root[j], True
    least = {}
    for i in range(n):
        ids = [rows[k][0] for k in range(n) if root[k] == root[i] and rows[k][0] is not None]
        least[i] = min(ids) if ids else None
    return [len(h) for h in hit], [least[i] for i in range(n)]


def test_hadamard():
    h = C.hadamard(np.eye(8))
    assert np.array_equal(h @ h.T, 8 * np.eye(8)) and set(np.unique(h)) == {-1, 1}


@pytest.mark.parametrize("width", [1, 2, 3])
def test_recall_at_the_threshold(width):
    """Pairs at a cosine of just 0.98 meet in some table."""
    a = RNG.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = RNG.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    ka, kb = (C.keys(v, width, width + 2, 2 * width) for v in (a, b))
    met = ((kb == ka[:, :, :1]).any(2) | (ka == kb[:, :, :1]).any(2)).any(1)
    assert met.mean() >= 0.99


@pytest.mark.parametrize("dim", [2, 3, 4, 5, 8, 100])
@pytest.mark.parametrize("largest", [500, 10**5, 10**7])
def test_recall_of_the_settings(dim, largest):
    """The same for the width, tables and probes that a class of this size gets, also in few dimensions."""
    a = RNG.normal(size=(500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = RNG.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    ka, kb = (C.keys(v, *C.settings(largest, dim)) for v in (a, b))
    met = ((kb == ka[:, :, :1]).any(2) | (ka == kb[:, :, :1]).any(2)).any(1)
    assert met.mean() >= 0.93


@pytest.mark.parametrize("limit,largest", [(C.LIMIT, None), (16, None), (C.LIMIT, 10**6)])
def test_links_equal_brute_force(spark, monkeypatch, limit, largest):
    if largest:
        monkeypatch.setattr(C, "BUCKET", 1)  # wider keys
    x = clustered(400)
    x[:40] = x[0] + 0.01 * RNG.normal(size=(40, 64))
    rows = [(int(i * 3), [float(v) for v in x[i]], int(i % 2)) for i in range(len(x))]
    rows += [(1, None, 0), (4, [0.0] * 64, 0), (7, [float("nan")] + [1.0] * 63, 0), (10, [None] + [1.0] * 63, 0), (13, rows[0][1], None), (16, [1.0, 2.0], 0),
             (19, [2.0, 4.0], 0), (22, [3.0], 0), (25, [5.0], 0), (28, [-5.0], 0), (31, [], 0), (34, [1e38] * 64, 1), (37, [1e-38] * 64, 1), (40, [float("inf")] * 2, 0)]
    rows += [(43, rows[0][1], 0)] * 3 + [(None, rows[2][1], 0), (None, [1.0, -1.0], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, key int")
    got = C.near_duplicates(df, limit=limit).collect()
    want = [(r[0], n, c, r[0] is not None and r[0] == c) for r, n, c in zip(rows, *brute([(r[0], None if r[1] is None else [None if v is None else np.float32(v) for v in r[1]], r[2]) for r in rows]))]
    order = lambda rs: sorted((tuple(r) for r in rs), key=str)
    assert order(got) == order(want)


def test_empty(spark):
    assert C.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
