"""The most similar vectors of every vector (problem 3), by randomly rotated one-bit codes.

Exact copies are searched once. Every distinct vector is expressed against its nearest centroid and
rotated at random; the signs of the residual are its code (one bit a dimension), beside two
correction scalars. A query visits the clusters of its nearest centroids. There its residual is cut
to four bits a dimension, inner products with all codes come from AND and popcount on packed words,
and each estimate has an error bound. Only pairs whose upper bound reaches the wanted cosine, and
is not below the k-th best lower bound of the query, go on to the exact cosine.

Clusters of many members are searched in blocks and their queries in slices, so no task holds a
whole cluster. What travels to the clusters is a code of a byte a dimension, not the vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.sizes import broadcast_if_small
from inkstone.session import cut

DIMENSIONS = 128
K = 10
#: Vectors a cluster has on average, and the most centroids of a model.
CLUSTER_SIZE, MAX_CENTROIDS = 600, 4096
#: Centroids are fitted on at most this many sampled vectors per centroid (all vectors are indexed).
SAMPLE_PER_CENTROID = 24
#: Clusters a query visits; the knob between recall and work.
PROBES = 20
#: Standard deviations of the error bound of an estimate.
EPSILON = 2.5
#: Members and queries that one task compares.
BLOCK_MEMBERS, BLOCK_QUERIES = 4096, 16384
#: Groups of exact copies above this size get their neighbours by broadcast instead of a shuffled join.
HOT_GROUP = 10_000
#: Decimals to which cosines are equal for the order of neighbours.
TIE_DECIMALS = 10
SEED = 11


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """True for vectors of the right length, of finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0)


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 4, seed: int = SEED) -> np.ndarray:
    """Spherical k-means from a random start, so that dense regions get their share of centroids."""
    start = np.random.default_rng(seed).choice(len(sample), size=min(count, len(sample)), replace=False)
    centres = sample[np.sort(start)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        sizes = np.bincount(nearest, minlength=len(centres))
        norms = np.linalg.norm(sums, axis=1)
        kept = (sizes > 0) & (norms > 0)
        centres[kept] = sums[kept] / norms[kept, None]
    return centres


def matrix(column: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def normal(column: pa.Array) -> np.ndarray:
    """Vectors at length 1, in double."""
    raw = matrix(column, DIMENSIONS)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def encode(unit: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated residuals and their scalars ``(norm, alignment, <residual, centre>)``."""
    residual = unit - centre
    norm = np.linalg.norm(residual, axis=1)
    turned = residual @ turn
    width = unit.shape[1]
    aligned = np.abs(turned).sum(axis=1) / (np.maximum(norm, 1e-12) * np.sqrt(width))
    bits = np.packbits(turned > 0, axis=1, bitorder="little")
    return bits, np.stack([norm, np.maximum(aligned, 1e-3), (residual * centre).sum(axis=1)], axis=1).astype(np.float32)


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, padded with zeros."""
    extra = -bits.shape[1] % 8
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, extra)))).view(np.uint64)


def estimate(turned: np.ndarray, own: np.ndarray, codes: np.ndarray, scalars: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries with coded vectors, and their error bounds.

    ``turned`` are rotated residuals of the queries against the cluster's centre, ``own`` their
    inner products with the centre. Each residual is cut to four bits a dimension, one bit plane a
    power of two, so that inner products are sums of popcounts.
    """
    width = turned.shape[1]
    turned = turned.astype(np.float32)
    low, high = turned.min(axis=1), turned.max(axis=1)
    step = np.maximum((high - low) / np.float32(15), np.float32(1e-12))
    cut4 = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 15).astype(np.uint8)
    total = np.zeros((len(turned), len(codes)), dtype=np.uint16 if width < 4096 else np.uint32)
    for power in range(4):
        plane = words(np.packbits((cut4 >> power) & 1, axis=1, bitorder="little"))
        ones = np.bitwise_count(plane[:, 0, None] & codes[None, :, 0]).astype(total.dtype)
        for w in range(1, codes.shape[1]):
            ones += np.bitwise_count(plane[:, w, None] & codes[None, :, w])
        ones <<= power
        total += ones
    held = np.bitwise_count(codes).sum(axis=1, dtype=np.int32).astype(np.float32)
    norm, aligned, against = scalars[:, 0], scalars[:, 1], scalars[:, 2]
    stretch = (norm / aligned).astype(np.float32)
    cosine = total.astype(np.float32)
    cosine *= 2 * step[:, None]
    cosine += 2 * low[:, None] * held[None, :]
    cosine -= (low * width + step * cut4.sum(axis=1, dtype=np.float32))[:, None]
    cosine *= (stretch / np.float32(np.sqrt(width)))[None, :]
    cosine += own.astype(np.float32)[:, None] + against[None, :]
    spread = (stretch * np.sqrt(np.maximum(1 - aligned**2, 0)) * np.float32(epsilon / np.sqrt(width - 1))).astype(np.float32)
    # the cut to four bits moves the inner product by at most about this much (one standard deviation, times epsilon)
    bound = np.linalg.norm(turned, axis=1)[:, None] * spread[None, :]
    bound += (np.float32(epsilon / np.sqrt(12)) * step)[:, None] * stretch[None, :]
    bound += np.float32(0.01)
    return cosine, bound


def candidates(query_ids, turned, own, member_ids, codes, scalars, k: int, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block that may belong to a query's k most similar and reach the wanted cosine."""
    first, second = [], []
    for a in range(0, len(query_ids), 256):
        cosine, bound = estimate(turned[a : a + 256], own[a : a + 256], codes, scalars)
        keep = cosine + bound >= min_cosine
        many = np.flatnonzero(keep.sum(axis=1) > k + 1)
        if len(many):
            # the query itself may stand in its own block, so one more than k is looked at
            lower = cosine[many] - bound[many]
            best = np.partition(lower, -(k + 1), axis=1)[:, -(k + 1)]
            keep[many] &= cosine[many] + bound[many] >= best[:, None]
        q, m = np.nonzero(keep)
        own_ids, other_ids = query_ids[a : a + 256][q], member_ids[m]
        different = own_ids != other_ids
        first.append(own_ids[different])
        second.append(other_ids[different])
    return np.concatenate(first), np.concatenate(second)


def _index(distinct: DataFrame, models: list, sizes: dict, seed: int) -> dict:
    """Centroids of each model from one pass over a bounded sample, chosen by a hash of the id."""
    wanted = {m: max(1, min(MAX_CENTROIDS, round(sizes[m] / CLUSTER_SIZE))) for m in models}
    share = F.lit(0.0)
    for m in models:
        share = F.when(F.col("model").eqNullSafe(F.lit(m)), F.lit(min(1.0, 1.1 * SAMPLE_PER_CENTROID * wanted[m] / sizes[m] + 50 / sizes[m]))).otherwise(share)
    part = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    rows = distinct.where(part < share).select("model", "vec_id", "embedding").toArrow()
    names = rows.column("model").to_pylist()
    units = normal(rows.column("embedding").combine_chunks()).astype(np.float32) if rows.num_rows else np.zeros((0, DIMENSIONS), np.float32)
    order = np.argsort(np.array(rows.column("vec_id").to_pylist(), dtype=np.int64), kind="stable")
    index = {}
    for m in models:
        own = units[[i for i in order if names[i] == m]]
        if len(own) == 0:
            own = np.eye(1, DIMENSIONS, dtype=np.float32)
        index[m] = fit_centroids(own, wanted[m], seed=seed)
    return index


def similar_pairs(df: DataFrame, k: int = K, min_cosine: float = 0.8, probes: int = PROBES, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of distinct vectors ``(a, b, cosine)``, the distinct vectors, and the members of their groups."""
    spark = df.sparkSession
    clean = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "model", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(seed), "embedding").alias("h2"))
    group = ["model", "h1", "h2"]
    members = cut(clean.select("vec_id", *group).distinct())
    distinct = clean.groupBy(*group).agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("v"), F.count(F.lit(1)).alias("n"))

    kinds = dict(clean.dtypes)
    # vectors travel as they came, in single floats; they are brought to length 1 where they are used
    distinct = cut(distinct.select(*group, "v.vec_id", "v.embedding", "n"))
    sizes = {r["model"]: r["n"] for r in distinct.groupBy("model").agg(F.count(F.lit(1)).alias("n")).limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("more than 1000 models")
    models = sorted(sizes, key=lambda m: (m is None, m))
    turn = rotation(DIMENSIONS, seed)
    shared = spark.sparkContext.broadcast((models, _index(distinct, models, sizes, seed), turn))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index, turn = shared.value
        number = {m: i for i, m in enumerate(names)}
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = normal(batch.column("embedding")).astype(np.float32)
            which = np.array([number[m] for m in batch.column("model").to_pylist()])
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for i in np.unique(which):
                own, centres = unit[which == i], index[names[i]]
                near = own @ centres.T
                count = min(probes, len(centres))
                visit = np.argpartition(-near, count - 1, axis=1)[:, :count].astype(np.int32)
                home = near.argmax(axis=1).astype(np.int32)
                bits, scalars = encode(own, centres[home], turn)
                turned = own @ turn
                scale = np.abs(turned).max(axis=1, keepdims=True) / 127
                coarse = np.rint(turned / scale).astype(np.int8)
                flat = np.concatenate([scale.astype(np.float32).view(np.uint8), coarse.view(np.uint8)], axis=1)
                stored = np.concatenate([np.ascontiguousarray(scalars).view(np.uint8), bits], axis=1)
                binary = lambda m: pa.array([r.tobytes() for r in m], type=pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * count), pa.array(visit.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(ids[which == i]), pa.array(home), binary(stored), binary(flat), lists], names=["m", "vec_id", "home", "code", "query", "visit"])

    coded = cut(distinct.select("model", "vec_id", "embedding").mapInArrow(code, f"m int, vec_id {kinds['vec_id']}, home int, code binary, query binary, visit array<int>"))
    held = coded.groupBy("m", F.col("home").alias("c")).agg(F.count(F.lit(1)).alias("held"))
    asked = coded.select("m", F.explode("visit").alias("c")).groupBy("m", "c").agg(F.count(F.lit(1)).alias("asked"))
    plan = held.join(asked, ["m", "c"]).select("m", "c", F.ceil(F.col("held") / BLOCK_MEMBERS).cast("int").alias("blocks"), F.ceil(F.col("asked") / BLOCK_QUERIES).cast("int").alias("slices"))
    plan = broadcast_if_small(plan)  # at most MAX_CENTROIDS rows a model
    part = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = coded.select("m", F.col("home").alias("c"), "vec_id", "code").join(plan, ["m", "c"]).withColumn("block", part("blocks")).withColumn("slice", every("slices"))
    asking = coded.select("m", F.explode("visit").alias("c"), "vec_id", "query").join(plan, ["m", "c"]).withColumn("slice", part("slices")).withColumn("block", every("blocks"))
    cell = ["m", "c", "block", "slice"]
    asking = asking.select(*[F.col(c).alias(f"q_{c}") for c in cell], F.col("vec_id").alias("q_id"), "query")

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names, index, turn = shared.value
        if left.num_rows and right.num_rows:
            centre = index[names[key[0].as_py()]][key[1].as_py()]
            packed = np.frombuffer(b"".join(right.column("code").to_pylist()), dtype=np.uint8).reshape(right.num_rows, -1)
            scalars = np.ascontiguousarray(packed[:, :12]).view(np.float32)
            codes = words(packed[:, 12:])
            asked = np.frombuffer(b"".join(left.column("query").to_pylist()), dtype=np.uint8).reshape(left.num_rows, -1)
            turned = np.ascontiguousarray(asked[:, 4:]).view(np.int8) * np.ascontiguousarray(asked[:, :4]).view(np.float32)
            base = centre @ turn
            own = turned @ base
            a, b = candidates(left.column("q_id").to_numpy(), turned - base, own, right.column("vec_id").to_numpy(), codes, scalars, k, min_cosine)
        else:
            a = b = np.zeros(0, dtype=np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        once = np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), dtype=np.int64)
        return pa.table({"a": once[:, 0], "b": once[:, 1]})

    pairs = asking.groupBy(*[f"q_{c}" for c in cell]).cogroup(stored.select(*cell, "vec_id", "code").groupBy(*cell)).applyInArrow(compare, "a bigint, b bigint").distinct()
    vectors = distinct.select("vec_id", "embedding")
    both = pairs.join(vectors.withColumnsRenamed({"vec_id": "a", "embedding": "ua"}), "a").join(vectors.withColumnsRenamed({"vec_id": "b", "embedding": "ub"}), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.einsum("ij,ij->i", normal(batch.column("ua")), normal(batch.column("ub"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.clip(cosine, -1, 1))], names=["a", "b", "cosine"])

    scored = both.select("a", "b", "ua", "ub").mapInArrow(exact, "a bigint, b bigint, cosine double").where(F.col("cosine") >= min_cosine)
    return cut(scored), distinct, members


def neighbour_pairs(df: DataFrame, k: int = K, min_cosine: float = 0.8, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """``vec_a, vec_b, cosine`` (smaller id first): pairs of one model where one is among the other's ``k`` most similar.

    ``df`` has ``vec_id, model, embedding``. Ties in the cosine go to the smaller id. Null, zero, not
    finite and wrongly sized vectors and null ids take no part, repeated rows of an id count once, a
    null model is a model of its own, copies of a vector are neighbours of cosine 1. An empty table
    gives no rows. Pairs below ``min_cosine`` are not sought.
    """
    scored, distinct, members = similar_pairs(df, k, min_cosine, probes, seed)
    group = ["model", "h1", "h2"]
    # nobody's k nearest hold more than the k + 1 smallest ids of one group of copies
    by_id = Window.partitionBy(*group).orderBy("vec_id")
    first = members.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k + 1)
    first = first.groupBy(*group).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    named = distinct.select(F.col("model").alias("gm"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("vec_id").alias("rep"), "n")
    same = [F.col("h1") == F.col("g1"), F.col("h2") == F.col("g2"), F.col("model").eqNullSafe(F.col("gm"))]
    first = cut(first.join(named, same).select("rep", "ids", "gm", "g1", "g2", "n"))
    edges = scored.select(F.col("a").alias("rep"), F.col("b").alias("other"), F.round("cosine", TIE_DECIMALS).alias("cosine"))
    edges = edges.unionByName(edges.select(F.col("other").alias("rep"), F.col("rep").alias("other"), "cosine"))
    own = first.where(F.size("ids") > 1).select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("cosine"))
    edges = edges.unionByName(own)
    best = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
    edges = edges.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    reached = edges.join(first.select(F.col("rep").alias("other"), "ids"), "other").select("rep", "cosine", F.explode("ids").alias("vec"))
    ranked = Window.partitionBy("rep").orderBy(F.desc("cosine"), "vec")
    near = reached.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k + 1)
    near = near.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("_r", "vec", "cosine"))).alias("near"))
    near = cut(near.join(first.select("rep", "gm", "g1", "g2", "n"), "rep"))
    lone = near.where(F.col("n") == 1).select(F.col("rep").alias("vec_id"), "near")
    shared = near.where(F.col("n") > 1).drop("rep")
    cold, hot = shared.where(F.col("n") <= HOT_GROUP), broadcast_if_small(shared.where(F.col("n") > HOT_GROUP))
    lists = lone
    for side in (cold, hot):
        lists = lists.unionByName(members.join(side, same).select("vec_id", "near"))
    others = F.slice(F.filter("near", lambda x: x["vec"] != F.col("vec_id")), 1, k)
    out = lists.select("vec_id", F.explode(others).alias("x")).select(F.least("vec_id", "x.vec").alias("vec_a"), F.greatest("vec_id", "x.vec").alias("vec_b"), "x.cosine")
    return out.groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))
