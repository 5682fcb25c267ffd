import math
import random

import numpy as np

from inkstone.operators import chunking as C
from inkstone.operators import community as M
from inkstone.operators import graph as G
from inkstone.operators import similarity as S
from inkstone.providers import HashingEmbedder


def test_cuts_keep_both_sides_long_enough():
    assert C.cut_points([149, 1000], [0.9], 0.5) == [(0, 2)]
    assert C.cut_points([150, 1000], [0.5], 0.5) == [(0, 2)]
    assert C.cut_points([150, 1000], [0.51], 0.5) == [(0, 1), (1, 2)]
    assert C.cut_points([200, 700, 700], [0.1, 0.2], 0.5) == [(0, 2), (2, 3)]
    assert C.cut_points([1600, 20], [0.9], 0.5) == [(0, 2)]
    rng = random.Random(3)
    for _ in range(50):
        words = [rng.randint(1, 80) for _ in range(rng.randint(1, 120))]
        dist = [rng.random() for _ in words]
        parts = C.cut_points(words, dist, 0.8)
        assert [a for a, _ in parts][0] == 0 and parts[-1][1] == len(words)
        assert all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        if len(parts) > 1:
            assert all(sum(words[a:b]) >= 150 for a, b in parts)


def glued(*items):
    """Ids by run and bearer of chunks given as ``(id, chapter, words[, parts])``."""
    parts = [i[3] if len(i) > 3 else 1 for i in items]
    return [([items[k][0] for k in range(r.first, r.last + 1)], items[r.bearer][0]) for r in C.runs([i[1] for i in items], [i[2] for i in items], parts)]


def test_glue():
    assert glued(("h", "1", 29), ("a", "2", 500)) == [(["h", "a"], "a")]
    assert glued(("a", "1", 500), ("t", "1", 30), ("b", "2", 500)) == [(["a", "t"], "a"), (["b"], "b")]
    assert glued(("a", "1", 500), ("t", "2", 30)) == [(["a", "t"], "a")]
    assert glued(("t", "1", 10)) == [(["t"], "t")] and glued() == []
    assert glued(("p", "1", 40, 2), ("b", "1", 500)) == [(["p"], "p"), (["b"], "b")]
    assert glued(("x", "1", 50), ("b", "2", 500)) == [(["x"], "x"), (["b"], "b")]
    assert glued(("a", "1", 60), ("b", "1", 60), ("c", "1", 60), ("d", "1", 10)) == [(["a", "b", "c", "d"], "c")]
    rng = random.Random(1)
    many = [(str(k), str(k // 5), rng.randint(1, 400)) for k in range(60)]
    assert [i for ids, _ in glued(*many) for i in ids] == [str(k) for k in range(60)]
    only = C.runs(["1", "1", "1"], [20, 20, 500], [1, 1, 1])
    assert [(r.first, r.last, r.words, r.also) for r in only] == [(0, 2, 540, [1])]


def find(title, text, lo=0):
    places = [(kind, pos) for t, kind, pos, _ in C.TitleIndex([title]).places(text, len(text))]
    by_kind = tuple(sorted(p for k, p in places if k == kind) for kind in (0, 1, 2))
    at = C.anchors([lo], [by_kind], len(text))[0]
    return at if any(by_kind) else None


def test_titles():
    assert find("Chapter 1", "see Chapter 10 and\nChapter 1 here") == 19
    assert find("Sec: A-B", "text\nSEC A B more") == 5
    assert find("Of moral sense and habit", "x\n  of moral sense, too") == 2
    assert find("Of moral sense and habit", "x of moral sense, too") is None
    assert find("Virtue", "of virtue_ and virtues\nfor virtue") == 27
    assert find("", "text") is None and find("absent", "text") is None


def naive_start(title, text, lo, hi):
    import re

    words = re.findall(r"[^\W_]+", title)
    for before, wanted in ((r"^[ \t]*", words), (r"(?<!\w)", words), (r"^[ \t]*", words[:3])):
        m = re.compile(before + r"[\W_]+".join(wanted) + r"(?!\w)", re.I | re.M).search(text, lo, hi) if words else None
        if m:
            return m.start()
    return None


def test_titles_as_a_search_finds_them(spark):
    rng = random.Random(4)
    words = ["of", "duty", "law", "the", "PART", "I", "x_y", "é"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\n  ", "-", "_"]) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    pages = [("d", k * 2 + 1, t or None) for k, t in enumerate(texts)]
    joined = "".join((t or "") + "\n" for _, _, t in pages)
    starts = [sum(len(t or "") + 1 for _, _, t in pages[:k]) for k in range(len(pages))]
    nodes, want, at = [], {}, 0
    first = 1
    for k in range(60):
        title = " ".join(rng.choice(["of", "duty", "law", "the", "part", "i", "é"]) for _ in range(rng.randint(1, 5)))
        first = min(first + rng.randint(0, 5), 305)
        nodes.append(("d", [k], str(k), title, first, first + rng.randint(0, 12)))
        page = lambda p: min(p // 2, len(pages) - 1)
        lo, last = max(at, starts[page(first)]), page(nodes[-1][5])
        hi = starts[last + 1] if last + 1 < len(pages) else len(joined)
        found = naive_start(title, joined, lo, hi)
        at = min(lo if found is None else found, len(joined) - 1)
        want[str(k)] = at
    n = spark.createDataFrame(nodes, "doc string, ord array<int>, node_path string, title string, first_page int, last_page int")
    p = spark.createDataFrame([(*x, s) for x, s in zip(pages, starts)], "doc string, page int, text string, start_off bigint")
    got = {r["node_path"]: r["start"] for r in C.section_spans(n, p).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_percentile_by_bins(spark, monkeypatch):
    from inkstone.functions import order

    rng = random.Random(2)
    values = [rng.choice([rng.random(), 0.25, 1e-9 * rng.random()]) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    monkeypatch.setattr(order, "FEW_VALUES", 50)
    monkeypatch.setattr(order, "BINS", 7)
    for p in (0, 12.5, 50, 95, 100):
        assert abs(order.exact_percentile(df, "v", p) - np.percentile(values, p)) < 1e-15
    assert order.exact_percentile(df.limit(0), "v", 50) is None


def test_next_edges_over_buckets(spark):
    c = spark.createDataFrame([("d", f"c{k}", k * 300) for k in range(7)] + [("e", "x", 1)], "doc string, chunk_id string, p int")
    got = {(r["a"], r["b"]) for r in G.next_edges(c, "p", bucket=512).collect()}
    assert got == {(f"c{k}", f"c{k + 1}") for k in range(6)}
    assert G.hops(G.next_edges(c, "p"), 3).count() == 6 + 5 + 4


def test_section_rows_nulls_and_repeats(spark):
    schema = "chunk_id string, doc string, author string, path array<string>, path_ids array<string>, start_page int, end_page int, section_summary string"
    c = spark.createDataFrame([("a", "d", "A", ["T", "U"], ["1", "2"], 3, 5, ""), ("b", "d", "A", ["T"], ["1"], 1, 2, "own"), ("c", "d", "A", None, None, 9, 9, None), ("e", "d", "A", [], [], 9, 9, None)], schema)
    got = {r["id"]: (r["depth"], r["parent"], r["start_page"], r["end_page"], r["summary"]) for r in G.section_rows(c).collect()}
    assert got == {"d::1": (1, None, 1, 5, "own"), "d::1/2": (2, "d::1", 3, 5, None)}
    assert G.section_rows(c.limit(0)).count() == 0


def test_links_have_no_pair_inside_a_document(spark):
    rows = [(1, "x", [1.0, 0.0]), (2, "x", [1.0, 0.0]), (3, "y", [0.6, 0.8]), (4, "y", [0.0, 0.0]), (5, "z", None), (3, "y", [0.6, 0.8])]
    v = S.usable_vectors(spark.createDataFrame(rows, "k bigint, d string, e array<double>"), "k", "d", "e")
    assert {(r["a"], r["b"]) for r in S.cross_links(v, 10, 0).collect()} == {(1, 3), (2, 3)}
    units = [[math.cos(k * k / 9), math.sin(k * k / 9)] for k in range(7)]
    scores = [a[0] * b[0] + a[1] * b[1] for i, a in enumerate(units) for b in units[i + 1 :]]
    for percentile in (0, 37, 90, 100):
        stats = S.cross_statistics(spark.createDataFrame([(k, str(k), u) for k, u in enumerate(units)], "id bigint, doc string, unit array<double>"), percentile).first()
        assert stats["pairs"] == 21 and abs(stats["threshold"] - np.percentile(scores, percentile)) < 1e-12
    assert S.cross_statistics(v.limit(0)).first()["pairs"] == 0


def ring(n, offset=0):
    return [(offset + i, offset + j, 1.0) for i in range(n) for j in range(i + 1, n)]


def quality(edges, of, gamma):
    m = sum(w for *_, w in edges)
    k = {}
    for a, b, w in edges:
        k[a] = k.get(a, 0) + w
        k[b] = k.get(b, 0) + w
    inside = sum(w for a, b, w in edges if of[a] == of[b]) / m
    volume = {}
    for n, x in k.items():
        volume[of[n]] = volume.get(of[n], 0) + x
    return inside - gamma * sum((x / (2 * m)) ** 2 for x in volume.values())


def connected(nodes, edges):
    nodes, seen = set(nodes), set()
    todo = [next(iter(nodes))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b if a == x else a for a, b, _ in edges if x in (a, b) and {a, b} <= nodes]
    return seen == nodes


def test_leiden_finds_cliques_and_keeps_its_promises():
    edges = ring(6) + ring(6, 6) + ring(6, 12) + [(0, 6, 1.0), (7, 12, 1.0)]
    of = M.leiden(edges, list(range(18)), 1.0)
    assert [of[n] for n in range(18)] == [0] * 6 + [6] * 6 + [12] * 6
    rng = random.Random(5)
    for seed in range(6):
        edges = list({(a, b): (a, b, rng.random()) for a, b in (sorted(rng.sample(range(40), 2)) for _ in range(110))}.values())
        nodes = sorted({x for a, b, _ in edges for x in (a, b)})
        for gamma in (0.5, 1.0, 3.0):
            of = M.leiden(edges, nodes, gamma, seed=seed)
            assert of == M.leiden(edges, nodes, gamma, seed=seed) and set(of) == set(nodes)
            assert quality(edges, of, gamma) >= quality(edges, {n: n for n in nodes}, gamma) - 1e-9
            for c in set(of.values()):
                assert connected([n for n in nodes if of[n] == c], edges)


def test_components_and_leiden_on_tables(spark):
    nodes = spark.createDataFrame([(k, "A" if k % 2 else "B") for k in range(14)], "id bigint, author string")
    chain = [(k, k + 1, 0.9) for k in range(0, 9)] + [(12, 11, 0.5), (11, 12, 0.5), (5, 5, 1.0)]
    links = spark.createDataFrame(chain, "a bigint, b bigint, score double")
    comp = {r["id"]: r["component"] for r in M.components(nodes, links).collect()}
    assert comp == {**{k: 0 for k in range(10)}, 10: 10, 11: 11, 12: 11, 13: 13}
    got = M.leiden_communities(nodes, links, (1.0, 3.0))
    assert got.count() == 28
    assert {r["id"] for r in got.where("resolution = 1.0 AND community = id AND id IN (10, 13)").collect()} == {10, 13}
    assert M.leiden_communities(nodes, links.limit(0)).where("community <> id").count() == 0
    m = M.modularity(got, links).collect()
    assert len(m) == 2


def test_large_components_fall_apart_first(spark, monkeypatch):
    monkeypatch.setattr(M, "COMPONENT_NODES", 5)
    edges = ring(4) + ring(4, 4) + ring(4, 8) + [(0, 4, 0.1), (5, 8, 0.1)]
    nodes = spark.createDataFrame([(k, "A") for k in range(12)], "id bigint, author string")
    got = {r["id"]: r["community"] for r in M.leiden_communities(nodes, spark.createDataFrame(edges, "a bigint, b bigint, score double"), (1.0,)).collect()}
    assert [got[k] for k in range(12)] == [0] * 4 + [4] * 4 + [8] * 4


def test_embedding_provider(spark):
    df = spark.createDataFrame([(1, "pride and habit"), (2, "pride and habit"), (3, ""), (4, None)], "k int, t string")
    got = {r["k"]: r["embedding"] for r in C.embed_with(df, ["k"], "t", HashingEmbedder(16)).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[3] is None and got[4] is None


def test_titles_of_every_tree_are_found_also_over_page_ends(spark, tmp_path):
    import json

    from inkstone.plans.chunks import find_titles

    texts = ["preface here\nOf the Nature", "of Moral Virtue\nbody text", "", "more words\nThe Last", None, "Things of All\nend"]
    starts = [sum(len(t or "") + 1 for t in texts[:k]) for k in range(len(texts))]
    first, last = len("preface here\n"), starts[3] + len("more words\n")

    def raw(*sections):
        return json.dumps({"structure": [{"title": t, "start_index": a, "end_index": b} for t, a, b in sections]})

    trees = [(1, "d", raw(("Of the Nature of Moral Virtue", 1, 2), ("The last things of all", 4, 6))), (2, "d", raw(("Moral virtue", 1, 3), ("The last things of all", 4, 5)))]
    spark.createDataFrame(trees, "tree_id bigint, doc string, raw string").write.parquet(str(tmp_path / "trees.parquet"))
    spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(texts)], "doc string, page int, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r["tree_id"], r["node_path"]): r["start"] for r in find_titles(spark, str(tmp_path)).collect()}
    # of the second tree the last title does not end on the section's pages, so it begins at its first page
    assert got == {(1, "0"): first, (1, "1"): last, (2, "0"): starts[1] + 3, (2, "1"): starts[3]}
