"""Pairs of vectors go through few large cells; what is sent and written grows with the vectors, not with pairs of blocks."""

import numpy as np

from inkstone.operators import similarity as S


def vectors(spark, n, size=16, docs=40, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, size)).astype(np.float32)
    m[5], m[9] = m[2], m[2]
    rows = [(int(k), f"d{k % docs}", [float(x) for x in v]) for k, v in enumerate(m)]
    return m, S.usable_vectors(spark.createDataFrame(rows, "k bigint, d string, e array<float>"), "k", "d", "e")


def naive(m, docs, k, percentile):
    e = m.astype(np.float64)
    u = e / np.sqrt(np.cumsum(e * e, axis=1)[:, -1:])
    n = len(u)
    s = np.stack([np.cumsum(u[i] * u, axis=1)[:, -1] for i in range(n)])
    other = np.arange(n)[:, None] % docs != np.arange(n)[None, :] % docs
    limit = np.percentile(s[np.triu(other, 1)], percentile)
    links = {}
    for i in range(n):
        for j in sorted(np.flatnonzero(other[i]), key=lambda j: (-s[i, j], j))[:k]:
            if s[i, j] >= limit:
                links[min(i, j), max(i, j)] = s[i, j]
    return {(int(a), int(b)): v for (a, b), v in links.items()}


def test_links_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL_GROUP", 100)
    m, v = vectors(spark, 330)
    for percentile in (90.0, 99.5):  # with the second the threshold cuts through the partners
        got = {(r["a"], r["b"]): r["score"] for r in S.cross_links(v, 10, percentile).collect()}
        want = naive(m, 40, 10, percentile)
        assert got == want
    monkeypatch.setattr(S, "LOOK", 60)  # a misleading look costs another count, not a result
    monkeypatch.setattr(S, "ASIDE", 1e-6)
    assert {(r["a"], r["b"]): r["score"] for r in S.cross_links(v, 10, 99.5).collect()} == want


def test_vectors_are_sent_a_few_times(spark, tmp_path):
    _, v = vectors(spark, 4500, docs=4500)
    v = S.cut_vectors(v)
    run, _ = S._cells(v)
    sent = [r["n"] for r in run(lambda cell: S.pa.table({"n": [0 if cell is None else cell.a.n + (0 if cell.own else cell.b.n)]}), "n bigint").collect()]
    assert sum(sent) <= 4500 * S.FEW_GROUPS
    run, _ = S._cells(v)
    lists = S._merged(run(lambda cell: S._near(cell, 10, S.WHOLE), S._RESULT), 10)
    assert lists.where("kind = 0").count() == 4500 and lists.where("kind = 1").count() <= S.BINS
