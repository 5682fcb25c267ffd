"""Links between similar vectors of different documents, under a threshold taken from all such pairs.

Pairs are never written out. Vectors lie in a few large groups; each pair of groups is a cell, one task, that goes
through its product in tiles, so a vector is sent to as many cells as there are groups. Products are made in single
precision, of which the error is bounded: where it could decide anything, among a vector's best partners or beside
a rank that is sought, the score is made again in double precision, summed from the first element on. Results are
those of double precision.
"""

from __future__ import annotations

import ctypes
import glob
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import author_pair
from inkstone.functions.vector import norm, unit
from inkstone.session import cut, release

TOP_K, PERCENTILE = 10, 90.0
#: Numbers of a group of vectors, which a task holds twice; vectors of a group from which there are up to FEW_GROUPS, for more tasks.
GROUP, SMALL_GROUP, FEW_GROUPS = 12 << 20, 16_384, 4
#: Sides of a tile, and vectors of the other side among which a first bound of the best partners is sought.
TILE, PIVOTS = 1024, 4096
#: Candidates that are kept before all but the best are dropped, and pairs that are scored exactly at once.
CANDIDATES, EXACT = 2_000_000, 8192
#: Bins of a histogram of scores, the first and the last of which hold all beyond them, and what it spans for all scores.
BINS, WHOLE = 1 << 16, (-1.01, 1.01)
#: Vectors of which all pairs tell about where a percentile lies, and by how much of all pairs it is sought on both sides.
LOOK, ASIDE = 4096, 0.01
#: Values that are sorted on the driver; above this they are counted in bins first.
FEW_VALUES = 100_000
#: Mark of pairs that do not count: below every score.
NONE = np.float32(-2)


def _exact_error(size: int) -> float:
    """What a score in single precision may differ from the one in double precision, for vectors of ``size`` numbers at length 1."""
    return 1.1 * (size + 8) * 2.0**-24


class _Side:
    """Vectors of one side of a cell, ordered by document: ``unit`` in single precision, ``full`` and ``length`` for exact scores."""

    def __init__(self, table: pa.Table, id: str, doc: str, vector: str, raw: bool):
        table = table.select([id, doc, vector]).combine_chunks()
        order = np.argsort(table.column(doc).to_numpy(), kind="stable") if table.num_rows else np.zeros(0, np.int64)
        self.n = table.num_rows
        self.ids = table.column(id).to_numpy()[order].astype(np.int64)
        names = table.column(doc).to_numpy()[order]
        self.starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if self.n else np.zeros(0, np.int64)
        self.docs = {d: k for k, d in enumerate(names[self.starts].tolist())}
        self.ends = np.append(self.starts[1:], self.n)
        chunk = table.column(vector).chunks[0] if self.n else None
        self.full = chunk.flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1)[order] if self.n else np.zeros((0, 1))
        self.length = np.ones(self.n)
        if raw:
            squares = np.zeros(self.n)
            for k in range(self.full.shape[1]):
                squares += np.square(self.full[:, k].astype(np.float64))
            self.length = np.sqrt(squares)
        self.unit = np.empty(self.full.shape, np.float32)
        for k in range(0, self.n, EXACT):
            self.unit[k : k + EXACT] = self.full[k : k + EXACT].astype(np.float64) / self.length[k : k + EXACT, None]

    def values(self, rows: np.ndarray) -> np.ndarray:
        return self.full[rows].astype(np.float64) / self.length[rows, None]


class _Cell:
    """All pairs of vectors of two groups, or within one (``right`` is None)."""

    def __init__(self, left: _Side, right: _Side | None):
        self.a, self.b, self.own = left, left if right is None else right, right is None
        self.error = _exact_error(left.full.shape[1])
        common = [(k, self.b.docs[d]) for d, k in left.docs.items() if d in self.b.docs]
        x, y = (np.array([c[side] for c in common], np.int64) for side in (0, 1))
        self.same = self.a.starts[x], self.a.ends[x], self.b.starts[y], self.b.ends[y]

    def scores(self, rows: range, cols: range) -> tuple[np.ndarray, int]:
        """Scores of a tile, those of pairs that do not count marked NONE, and how many these are."""
        s = self.a.unit[rows.start : rows.stop] @ self.b.unit[cols.start : cols.stop].T
        marked = False
        a0, a1, b0, b1 = self.same
        for k in np.flatnonzero((a1 > rows.start) & (a0 < rows.stop) & (b1 > cols.start) & (b0 < cols.stop)):
            s[max(0, a0[k] - rows.start) : a1[k] - rows.start, max(0, b0[k] - cols.start) : b1[k] - cols.start] = NONE
            marked = True
        if self.own and rows.start == cols.start:
            s[np.tri(*s.shape, dtype=bool)] = NONE
            marked = True
        return s, int(np.count_nonzero(s == NONE)) if marked else 0

    def tiles(self) -> Iterator[tuple[int, int, np.ndarray, int]]:
        for r in range(0, self.a.n, TILE):
            for c in range(r if self.own else 0, self.b.n, TILE):
                yield r, c, *self.scores(range(r, min(self.a.n, r + TILE)), range(c, min(self.b.n, c + TILE)))

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores in double precision, summed from the first element on."""
        out = np.empty(len(i))
        for k in range(0, len(i), EXACT):
            out[k : k + EXACT] = np.cumsum(self.a.values(i[k : k + EXACT]) * self.b.values(j[k : k + EXACT]), axis=1)[:, -1]
        return out


class _Best:
    """Candidates for the ``k`` best partners of each vector of one side; ``bound`` is a score that each of the best reaches."""

    def __init__(self, n: int, k: int, error: float, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray):
        self.k, self.error, self.exact, self.ids = k, error, exact, ids
        self.bound = np.full(n, -1.005, np.float32)
        self.kept, self.waiting, self.settled = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))], 0, 0

    def raise_to(self, scores: np.ndarray, rows: slice) -> None:
        """``scores`` are of distinct partners, as many columns as there are; the ``k``-th best is a bound."""
        if scores.shape[1] >= self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            self.bound[rows] = np.maximum(self.bound[rows], kth - np.float32(2.1 * self.error))

    def add(self, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
        self.kept.append((i.astype(np.int32), j.astype(np.int32), s))
        self.waiting += len(i)
        if self.waiting > max(CANDIDATES, 2 * self.settled):
            self.drop()

    def drop(self, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Only what may be among the best stays: by scores in single precision, by exact ones at the end or where equal scores are many."""
        i, j, s = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((-s, i))
        i, j, s = i[order], j[order], s[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(i)))
        full = size >= self.k
        self.bound[i[first[full]]] = np.maximum(self.bound[i[first[full]]], s[first[full] + self.k - 1] - np.float32(2.1 * self.error))
        stay = s >= self.bound[i]
        i, j, s = i[stay], j[stay], s[stay]
        exact = np.zeros(0)
        if whole or len(i) > 2 * self.k * len(self.bound) + CANDIDATES // 2:
            exact = self.exact(i, j)
            order = np.lexsort((self.ids[j], -exact, i))
            i, j, s, exact = i[order], j[order], s[order], exact[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            i, j, s, exact = (x[rank < self.k] for x in (i, j, s, exact))
        self.kept, self.waiting, self.settled = [(i, j, s)], len(i), len(i)
        return i, j, exact


def _flat_hits(mask: np.ndarray) -> np.ndarray:
    """Places of what is true in a mask where little is."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    return (words[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[words]]


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(_flat_hits(mask), mask.shape[1])


def _alone() -> None:
    """Products in one thread: a task has one core, and threads that wait for each other would burn another."""
    for path in glob.glob(f"{Path(np.__file__).parent.parent}/numpy.libs/*openblas*"):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


class _Histogram:
    """Counts of the scores of tiles in bins of equal width between ``low`` and ``high``."""

    def __init__(self, low: float, high: float):
        self.low, self.high = np.float32(low), np.float32(high)
        self.scale = (BINS - 2) / (float(self.high) - float(self.low))
        self.counts = np.zeros(BINS, np.int64)

    def add(self, s: np.ndarray, none: int) -> None:
        mask = s >= self.low
        from_low = int(np.count_nonzero(mask))
        mask &= s < self.high
        v = s.reshape(-1)[_flat_hits(mask)].astype(np.float64)
        self.counts[0] += s.size - none - from_low
        self.counts[-1] += from_low - len(v)
        self.counts += np.bincount(np.minimum((v - float(self.low)) * self.scale, BINS - 3).astype(np.int64) + 1, minlength=BINS)

    def window(self, counts: np.ndarray, rank: int, error: float) -> tuple[float, float] | None:
        """Between what scores the exact one of a rank (0-based) lies, given the counts; None if it is beyond the bins."""
        at = int(np.searchsorted(np.cumsum(counts), rank, side="right"))
        if at in (0, BINS - 1):
            return None
        low, width = float(self.low), 1 / self.scale
        return low + (at - 1.01) * width - 1.1 * error, low + (at + 0.01) * width + 1.1 * error


def _cells(vectors: DataFrame) -> tuple[Callable[[Callable, str], DataFrame], int]:
    """A function that runs ``f(cell)``, which yields tables of a schema, for all cells, and the size of the vectors."""
    raw = "raw" in vectors.columns
    vector = "raw" if raw else "unit"
    n, size = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    groups = max(1, math.ceil(n * max(1, size) / GROUP), min(FEW_GROUPS, math.ceil(n / SMALL_GROUP)))
    placed = vectors.select("id", "doc", F.col(vector).alias("vec"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"))
    left = placed.withColumn("other", F.explode(F.sequence(F.col("g"), F.lit(groups - 1)))).select(F.col("g").alias("ga"), F.col("other").alias("gb"), "id", "doc", "vec")
    right = placed.where("g > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(F.col("other").alias("ra"), F.col("g").alias("rb"), F.col("id").alias("rid"), F.col("doc").alias("rdoc"), F.col("vec").alias("rvec"))

    def run(f: Callable, schema: str) -> DataFrame:
        def cell(key: tuple[pa.Scalar, ...], x: pa.Table, y: pa.Table) -> pa.Table:
            _alone()
            a = _Side(x, "id", "doc", "vec", raw)
            own = key[0].as_py() == key[1].as_py()
            if not a.n or not (own or y.num_rows):
                return f(None)
            del x
            b = None if own else _Side(y, "rid", "rdoc", "rvec", raw)
            del y
            return f(_Cell(a, b))

        return left.groupBy("ga", "gb").cogroup(right.groupBy("ra", "rb")).applyInArrow(cell, schema)

    return run, size


def usable_vectors(df: DataFrame, key: str, doc: str, vector: str) -> DataFrame:
    """``id, doc, raw, unit``: one row an id, vectors as they came and at length 1; null, zero and not finite ones and null keys are left out."""
    made = df.where(F.col(key).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min_by(F.struct(F.col(doc).alias("doc"), F.col(vector).alias("v")), F.col(doc)).alias("r"))
    return with_units(made.select("id", F.col("r.doc").alias("doc"), F.col("r.v").alias("raw")).where(F.col("raw").isNotNull() & (norm(F.col("raw")) > 0) & (norm(F.col("raw")) < F.lit(float("inf")))))


def with_units(vectors: DataFrame) -> DataFrame:
    """``unit`` from ``raw``, made where it is read."""
    return vectors.select("id", "doc", "raw", unit(F.col("raw")).alias("unit"))


def cut_vectors(vectors: DataFrame) -> DataFrame:
    """Usable vectors, written as they came: half as large as at length 1."""
    made = with_units(cut(vectors.select("id", "doc", "raw")))
    release(vectors.sparkSession)
    return made


_RESULT = "kind int, id bigint, others array<bigint>, scores array<double>, n bigint"
_PARTNERS, _COUNT = 0, 1


def _listed(ids: np.ndarray, others: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Rows in the order of ``ids`` as one list an id."""
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(ids)).astype(np.int32))
    return ids[first], pa.ListArray.from_arrays(offsets, pa.array(others, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(scores, pa.float64()))


def _result(parts: list[tuple[np.ndarray, pa.Array, pa.Array]], counts: np.ndarray) -> pa.Table:
    """Lists of partners, and what is not 0 of the counts by bin."""
    bins = np.flatnonzero(counts)
    some = sum(len(p[0]) for p in parts)
    nothing = [pa.nulls(len(bins), pa.list_(t)) for t in (pa.int64(), pa.float64())]
    return pa.table({
        "kind": pa.array(np.repeat([_PARTNERS, _COUNT], [some, len(bins)]), pa.int32()),
        "id": pa.array(np.concatenate([*[p[0] for p in parts], bins]).astype(np.int64)),
        "others": pa.chunked_array([*[p[1] for p in parts], nothing[0]], pa.list_(pa.int64())),
        "scores": pa.chunked_array([*[p[2] for p in parts], nothing[1]], pa.list_(pa.float64())),
        "n": pa.chunked_array([pa.nulls(some, pa.int64()), pa.array(counts[bins].astype(np.int64))], pa.int64()),
    })


def _near(cell: _Cell | None, k: int, bounds: tuple[float, float] | None) -> pa.Table:
    """The ``k`` best partners of each vector within a cell, and counts of all its scores in bins between ``bounds``."""
    held = _Histogram(*(bounds or WHOLE))
    if cell is None:
        return _result([], held.counts)
    a, b = cell.a, cell.b
    rows = _Best(a.n, k, cell.error, cell.exact, b.ids)
    cols = rows if cell.own else _Best(b.n, k, cell.error, lambda i, j: cell.exact(j, i), a.ids)
    # first bounds, from the greatest scores of stretches of some partners; pairs within a document do not count here either
    for best, flip in ((rows, False),) if cell.own else ((rows, False), (cols, True)):
        here, there = (b, a) if flip else (a, b)
        some = np.unique(np.linspace(0, there.n - 1, min(there.n, PIVOTS)).astype(np.int64))
        picked = there.unit[some]
        there_doc = np.searchsorted(there.starts, some, side="right") - 1
        names = list(there.docs)
        at = np.array([here.docs.get(names[d], -1) for d in there_doc], np.int64)
        here_doc = np.repeat(np.arange(len(here.starts)), here.ends - here.starts)
        wide = len(some) // 64 * 64
        for r in range(0, here.n, TILE):
            s = here.unit[r : r + TILE] @ picked.T
            mine = here_doc[r : r + TILE]
            near = np.flatnonzero((at >= mine[0]) & (at <= mine[-1]))
            if len(near):
                block = s[:, near]
                block[mine[:, None] == at[near][None, :]] = NONE
                s[:, near] = block
            best.raise_to(s[:, :wide].reshape(len(s), 64, -1).max(axis=2) if wide == PIVOTS else s, slice(r, r + TILE))
    for r, c, s, none in cell.tiles():
        if bounds:
            held.add(s, none)
        x, y = rows.bound[r : r + s.shape[0]], cols.bound[c : c + s.shape[1]]
        mask = s >= x[:, None]
        mask |= s >= y
        i, j = _hits(mask)
        if len(i):
            v = s[i, j]
            of_row, of_col = v >= x[i], v >= y[j]
            rows.add(i[of_row] + r, j[of_row] + c, v[of_row])
            cols.add(j[of_col] + c, i[of_col] + r, v[of_col])
    parts = []
    for best, here, there in ((rows, a, b),) if cell.own else ((rows, a, b), (cols, b, a)):
        i, j, score = best.drop(whole=True)
        parts.append(_listed(here.ids[i], there.ids[j], score))
    return _result(parts, held.counts)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The results of all cells: lists of the ``k`` best partners, the best first, equal scores by id, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, got = np.zeros(BINS, np.int64), []
        for b in batches:
            kind, id_ = b.column(0).to_numpy(), b.column(1).to_numpy()
            np.add.at(counts, id_[kind == _COUNT], b.column(4).to_numpy(zero_copy_only=False)[kind == _COUNT].astype(np.int64))
            mine = b.filter(pa.array(kind == _PARTNERS))
            if mine.num_rows:
                lists = mine.column(2)
                got.append((np.repeat(mine.column(1).to_numpy(), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), mine.column(3).flatten().to_numpy()))
        parts = []
        if got:
            ids, others, scores = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((others, -scores, ids))
            ids, others, scores = ids[order], others[order], scores[order]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            best = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids)))) < k
            parts = [_listed(ids[best], others[best], scores[best])]
        yield from _result(parts, counts).combine_chunks().to_batches()

    return found.repartition("kind", "id").mapInArrow(run, _RESULT)


def _partner_rows(merged: DataFrame) -> DataFrame:
    """``id, other, rank, score``."""
    zipped = merged.where(F.col("kind") == _PARTNERS).select("id", F.posexplode(F.arrays_zip("others", "scores")).alias("p", "x"))
    return zipped.select("id", F.col("x.others").alias("other"), (F.col("p") + 1).cast("int").alias("rank"), F.col("x.scores").alias("score"))


def top_partners(vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """``id, other, score, rank``: each vector's ``k`` most similar of other documents; ties go to the smaller id."""
    run, _ = _cells(vectors)
    return _partner_rows(_merged(run(lambda cell: _near(cell, k, None), _RESULT), k)).select("id", "other", "score", "rank")


def _counts(found: DataFrame) -> np.ndarray:
    """Scores by bin, from at most BINS rows."""
    out = np.zeros(BINS, np.int64)
    for r in found.where(F.col("kind") == _COUNT).groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _counted(vectors: DataFrame, bounds: tuple[float, float]) -> np.ndarray:
    """Counts of all scores in bins between ``bounds``."""

    def run(cell: _Cell | None) -> pa.Table:
        held = _Histogram(*bounds)
        for _, _, s, none in cell.tiles() if cell else ():
            held.add(s, none)
        return _result([], held.counts)

    return _counts(_cells(vectors)[0](run, _RESULT))


def _about(vectors: DataFrame, percentile: float) -> tuple[float, float]:
    """Scores between which a percentile of all pairs is likely to lie, by the pairs of some vectors.

    Where it does not, the counts show it and are made over the whole range; so this decides time, never a result.
    """
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(LOOK).select("doc", "raw" if "raw" in vectors.columns else "unit").toArrow()
    if some.num_rows < LOOK:
        return WHOLE
    side = _Side(some.append_column("id", pa.array(np.arange(some.num_rows))), "id", "doc", some.column_names[1], "raw" in vectors.columns)
    s = np.concatenate([t[t != NONE] for _, _, t, _ in _Cell(side, None).tiles()])
    if not len(s):
        return WHOLE
    part = percentile / 100
    low, high = np.quantile(s, [max(0.0, part - ASIDE), min(1.0, part + ASIDE)])
    return (float(low) if part > ASIDE else WHOLE[0]), (float(high) + 1e-4 if part < 1 - ASIDE else WHOLE[1])


def _at_ranks(vectors: DataFrame, held: dict[int, tuple[float, float]]) -> dict[int, float]:
    """The exact scores of some ranks, each with the window it lies in: one more product of all cells gives the values there."""
    run, _ = _cells(vectors)
    windows = sorted(set(held.values()))

    def near(cell: _Cell | None) -> pa.Table:
        below, kept = [0] * len(windows), [[(np.zeros(0), np.zeros(0, np.int64))] for _ in windows]
        for r, c, s, none in cell.tiles() if cell else ():
            for w, (low, high) in enumerate(windows):
                mask = s >= np.float32(low - 1.1 * cell.error)
                below[w] += s.size - int(np.count_nonzero(mask)) - none
                mask &= s <= np.float32(high + 1.1 * cell.error)
                i, j = _hits(mask)
                v = cell.exact(i + r, j + c)
                below[w] += int(np.count_nonzero(v < low))
                kept[w].append(np.unique(v[(v >= low) & (v <= high)], return_counts=True))
                if sum(len(x[0]) for x in kept[w][1:]) > max(CANDIDATES, len(kept[w][0][0])):
                    kept[w] = [_summed(kept[w])]
        rows = [(w, *_summed(kept[w])) for w in range(len(windows))]
        return pa.table({
            "w": pa.array(np.concatenate([np.repeat(np.arange(len(windows)), [len(x[1]) for x in rows]), np.arange(len(windows))]), pa.int32()),
            "v": pa.chunked_array([pa.array(np.concatenate([x[1] for x in rows])), pa.nulls(len(windows), pa.float64())]),
            "n": pa.array(np.concatenate([*[x[2] for x in rows], np.array(below)]).astype(np.int64)),
        })

    found = cut(run(near, "w int, v double, n bigint"))
    below = {r["w"]: r["n"] for r in found.where("v IS NULL").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    out = {}
    for rank, window in held.items():
        w = windows.index(window)
        out[rank] = _weighted(found.where((F.col("w") == w) & F.col("v").isNotNull()), rank - below[w])
    return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    v, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    values, where = np.unique(v, return_inverse=True)
    return values, np.bincount(where, weights=n, minlength=len(values)).astype(np.int64)


def _weighted(values: DataFrame, rank: int) -> float:
    """The value of a rank among ``v``, each of which stands for ``n``; many are counted in bins first, and then the bin that holds the rank."""
    while True:
        rows, lo, hi = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
        if lo == hi or rows <= FEW_VALUES:
            break
        at = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / 4096)), F.lit(4095))
        for b in values.groupBy(at.alias("b")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect():  # at most 4096 rows
            if rank < b["n"]:
                break
            rank -= b["n"]
        values = values.where((F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))
    if lo == hi:
        return lo
    v, n = _summed([(np.array([r["v"]]), np.array([r["n"]])) for r in values.select("v", "n").collect()])
    return float(v[np.searchsorted(np.cumsum(n), rank, side="right")])


def _between(found: dict[int, float], place: float) -> float:
    low, high = found[math.floor(place)], found[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


def cross_statistics(vectors: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """One row ``pairs, threshold, min_score, median_score, max_score`` over all pairs of vectors of different documents; exact."""

    schema = "pairs bigint, threshold double, min_score double, median_score double, max_score double"
    counts = _counted(vectors, WHOLE)
    pairs = int(counts.sum())
    if not pairs:
        return vectors.sparkSession.createDataFrame([(0, None, None, None, None)], schema)
    places = [(pairs - 1) * percentile / 100, (pairs - 1) * 0.5]
    ranks = {0, pairs - 1, *[f(p) for p in places for f in (math.floor, math.ceil)]}
    error = _exact_error(_cells(vectors)[1])
    found = _at_ranks(vectors, {r: _Histogram(*WHOLE).window(counts, r, error) for r in ranks})
    return vectors.sparkSession.createDataFrame([(pairs, _between(found, places[0]), found[0], _between(found, places[1]), found[pairs - 1])], schema)


def cross_histogram(vectors: DataFrame, bins: int = 60) -> DataFrame:
    """``bin, n`` over all pairs of vectors of different documents; bins of equal width over -1..1."""
    half = bins / 2

    def run(cell: _Cell | None) -> pa.Table:
        counts = np.zeros(bins, np.int64)
        place = lambda v: np.clip(np.floor((v + 1) * half).astype(np.int64), 0, bins - 1)
        for r, c, s, _ in cell.tiles() if cell else ():
            # scores that single precision cannot tell from a bin's edge are made again
            scaled = (s.astype(np.float64) + 1) * half
            close = (np.abs(scaled - np.rint(scaled)) <= 1.1 * cell.error * half) & (s != NONE)
            i, j = _hits(close)
            counts += np.bincount(place(s[~close & (s != NONE)].astype(np.float64)), minlength=bins) + np.bincount(place(cell.exact(i + r, j + c)), minlength=bins)
        some = np.flatnonzero(counts)
        return pa.table({"bin": some.astype(np.int64), "n": counts[some]})

    return _cells(vectors)[0](run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))


def cross_links(vectors: DataFrame, k: int = TOP_K, percentile: float = PERCENTILE) -> DataFrame:
    """``a, b, score`` (a < b): pairs of different documents where one is among the other's ``k`` best and the threshold is reached.

    Same-document vectors are left out before ranking, so small corpora give no links inside a document. The
    product of all cells is made once for partners and counts. The counts tell the threshold but for a narrow window;
    only if some partner's score lies within it is the product made again, for the exact value.
    """
    bounds = _about(vectors, percentile)
    run, size = _cells(vectors)
    both = cut(_merged(run(lambda cell: _near(cell, k, bounds), _RESULT), k))
    release(vectors.sparkSession)
    counts = _counts(both)
    pairs = int(counts.sum())
    near = _partner_rows(both)
    limit = 2.0
    if pairs:
        place = (pairs - 1) * percentile / 100
        ends = {math.floor(place), math.ceil(place)}
        windows = {r: _Histogram(*bounds).window(counts, r, _exact_error(size)) for r in ends}
        if None in windows.values():
            counts = _counted(vectors, WHOLE)
            windows = {r: _Histogram(*WHOLE).window(counts, r, _exact_error(size)) for r in ends}
        low, limit = windows[min(ends)][0], windows[max(ends)][1]
        if not near.where((F.col("score") >= F.lit(low)) & (F.col("score") <= F.lit(limit))).isEmpty():
            limit = _between(_at_ranks(vectors, windows), place)
            release(vectors.sparkSession)
    pairs_of = near.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("score").alias("score"))
    return pairs_of.where(F.col("score") >= F.lit(limit)).select("a", "b", "score")


def with_authors(links: DataFrame, authors: DataFrame) -> DataFrame:
    """Adds ``author_a, author_b`` from ``id, author``."""
    first = authors.select(F.col("id").alias("a"), F.col("author").alias("author_a"))
    second = authors.select(F.col("id").alias("b"), F.col("author").alias("author_b"))
    return links.join(first, "a").join(second, "b").select("a", "b", "score", "author_a", "author_b")


def links_per_pair(links: DataFrame) -> DataFrame:
    return links.groupBy(author_pair(F.col("author_a"), F.col("author_b")).alias("pair")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def unlinked(ids: DataFrame, links: DataFrame) -> DataFrame:
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    return ids.select("id").join(ends, "id", "left_anti")


def between(links: DataFrame, one: str, other: str, most: int = 25) -> DataFrame:
    """The strongest links between two authors, whichever way round they are stored."""
    hit = links.where((F.col("author_a") == one) & (F.col("author_b") == other) | (F.col("author_a") == other) & (F.col("author_b") == one))
    return hit.orderBy(F.desc("score"), "a", "b").limit(most)
