import numpy as np

from inkstone.llm import neighbours as N

SCHEMA = "vec_id bigint, chunk_id string, model string, embedding array<float>"


def brute_force(rows, k=10, least=0.8):
    best = {}
    for i, _, m, e in rows:
        if i is not None and e is not None and len(e) == 128 and all(x is not None and np.isfinite(x) for x in e) and any(e):
            best.setdefault(i, (m, e))
    out = set()
    for m in {x[0] for x in best.values()}:
        ids = np.array(sorted(i for i in best if best[i][0] == m))
        x = np.array([best[i][1] for i in ids], dtype=np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 10)
        np.fill_diagonal(s, -9)
        for a, row in zip(ids, s):
            c = np.flatnonzero(row >= least)
            for j in c[np.lexsort((ids[c], -row[c]))][:k]:
                out.add((min(a, ids[j]), max(a, ids[j])))
    return {(int(a), int(b)) for a, b in out}


def made(seed=0):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(120):
        centre = rng.standard_normal(128)
        for _ in range(rng.integers(1, 25)):
            v = centre + rng.uniform(0, 0.6) * rng.standard_normal(128)
            rows.append((n, f"c{n}", "m" if n % 7 else None, [float(x) for x in v * rng.uniform(0.1, 9)]))
            n += 1
    rows += [(n + k, None, "m", rows[0][3]) for k in range(15)]  # more copies than neighbours
    rows += [(n + 20 + k, None, "m", [2 * x for x in rows[30][3]]) for k in range(3)]
    bad = [None, [], [0.0] * 128, [float("nan")] + [1.0] * 127, [1.0] * 127, [None] + [1.0] * 127, [float("inf")] + [1.0] * 127]
    rows += [(n + 40 + k, None, "m", b) for k, b in enumerate(bad)] + [rows[5], rows[5], (None, None, "m", rows[1][3])]
    return rows


def test_pairs_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_GROUP", 10)
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["vec_a"], r["vec_b"]) for r in N.neighbour_pairs(df).collect()}
    want = brute_force(rows)
    assert len(want & got) >= 0.98 * len(want) and got - want == set() and len(want) > 1000


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    rows = made(3)[:500]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {tuple(r)[:2] for r in N.neighbour_pairs(df).collect()}
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 40)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 64)
    assert {tuple(r)[:2] for r in N.neighbour_pairs(df).collect()} == one


def test_empty_and_useless(spark):
    df = spark.createDataFrame([(1, "a", "m", None), (2, "b", "m", [1.0])], SCHEMA)
    assert N.neighbour_pairs(df).count() == 0 and N.neighbour_pairs(df.limit(0)).count() == 0


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 128)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = (x.mean(axis=0) + 0.05).astype(np.float32)
    turn = N.rotation(128)
    bits, scalars = N.encode(x, centre, turn)
    queries = x[:60] @ turn
    cosine, bound = N.estimate(queries - centre @ turn, queries @ (centre @ turn), N.words(bits), scalars)
    error = np.abs(cosine - x[:60] @ x.T)
    assert (error <= bound).mean() > 0.97 and error.mean() < 0.08
