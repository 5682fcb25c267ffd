"""Subject areas of documents (problem 9): complement naive Bayes, expectation-maximization, calibration.

A document is read as segments (about sentences), each about one subject or none. Segments are sets
of hashed words, word pairs or, in scripts without spaces, character n-grams. Complement weights are
first taken from the labelled documents, then refined by expectation-maximization over the segments
of all documents, where labels only tilt the prior of their own documents, so that wrong and missing
labels do not hold. A document's evidence for a subject is its expected number of segments; posteriors
per subject, independent of each other, are calibrated on labelled documents held back from the training.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.sizes import broadcast_if_small
from inkstone.session import cut

#: Hash buckets of features: the size of the model, whatever the corpus.
BUCKETS = 1 << 18
#: Rounds of expectation-maximization over all documents, at most; they end before when the likelihood of the held labels no longer rises.
ROUNDS = 5
#: One labelled document of so many (by a hash of its id) is held back from training; its labels end the rounds and fit the calibration.
HELD = 4
#: Held documents, at most, that the driver reads for that (by a hash of the id).
CALIBRATION_DOCUMENTS = 50_000
#: Held documents of a subject at which its own calibration counts as much as that of all subjects together.
CALIBRATION_TRUST = 300.0
#: Most subjects the model holds; the table of subjects is checked against it.
MAX_SUBJECTS = 256
SMOOTHING = 0.5
#: Weights closer to 0 than this say nothing, and none counts more than the largest.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 4.0
#: Observations of a feature at which its weight counts half.
HALF_TRUST = 3.0
#: What a document without labels adds to expected counts, against 1 of a labelled one.
UNLABELLED = 0.2
#: Prior of a segment: about no subject, about a labelled subject of its document, about any other.
PRIOR_LABELLED, PRIOR_OTHER = 0.4, 0.02
#: Segments that the general prior counts as against a document's own.
MIXTURE = 2.0
THRESHOLD = 0.5
MEMO = 300_000
#: Tasks that gather counts; each reads many partitions of the documents one after the other.
GATHER_TASKS = 2048

SEGMENT = re.compile(r"[.!?。！？।|;；]+(?=[\s\"'”’»」)\]]|$)|(?<=[。！？])|\n\s*\n|(?<=[฀-๿])[ ]+(?=[฀-๿])|(?<=[぀-鿿])[ 　]+(?=[぀-鿿])")
WORD = re.compile(r"[^\s.,!?;:()\[\]“”„«»\"'‘’—–\-।|。，、！？；：（）「」…]+")
THAI = re.compile("[฀-๿]")
CJK = re.compile("[぀-ヿ㐀-鿿]")
HIDDEN = re.compile("[​­‌‍⁠﻿]")


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & (BUCKETS - 1)


def features(segment: str) -> set[str]:
    """Words and neighbouring pairs; in scripts without spaces the character n-grams of each run."""
    out: set[str] = set()
    words = WORD.findall(segment)
    last = ""
    for w in words:
        if CJK.search(w):
            out.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
            last = ""
        elif THAI.search(w):
            out.update(w[i : i + n] for n in (4, 6) for i in range(len(w) - n + 1))
            last = ""
        else:
            if len(w) > 2 and not w.isdigit():
                out.add(w)
            if last:
                out.add(f"{last} {w}")
            last = w
    return out


class Reader:
    """Texts to segments of bucket numbers, with a memory for repeated features."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def segments(self, text: str) -> list[list[int]]:
        clean = HIDDEN.sub("", unicodedata.normalize("NFC", text)).lower()
        out = []
        for part in SEGMENT.split(clean):
            if part and not part.isspace():
                ids = []
                for f in features(part):
                    b = self.memo.get(f)
                    if b is None:
                        if len(self.memo) > MEMO:
                            self.memo.clear()
                        b = self.memo[f] = bucket(f)
                    ids.append(b)
                if len(ids) > 1:
                    out.append(ids)
        return out


def pack(ids: list[int]) -> bytes:
    """Bucket numbers (below 2**24) in three byte planes, compressed: what the corpus of segments takes on disk."""
    return pa.compress(np.array(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), codec="zstd", asbytes=True) if ids else b""


def unpack(packed: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, dtype=np.int64)
    planes = np.frombuffer(pa.decompress(packed, 3 * count, codec="zstd", asbytes=True), dtype=np.uint8).reshape(3, count).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def read_documents(documents: DataFrame, labels: DataFrame | None, subjects: list[str], key: str, text: str) -> DataFrame:
    """``key, sizes, ids, mask``: segments of every document as packed bucket numbers; ``mask`` lists the subjects of its labels."""
    source = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    schema = f"{key} {dict(source.dtypes)[key]}, sizes array<int>, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            sizes, ids = [], []
            for t in batch.column(1).to_pylist():
                parts = reader.segments(t)
                sizes.append([len(p) for p in parts])
                ids.append(pack([i for p in parts for i in p]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.list_(pa.int32())), pa.array(ids, type=pa.binary())], names=[key, "sizes", "ids"])

    number = F.create_map(*[x for k, s in enumerate(subjects) for x in (F.lit(s), F.lit(k))])
    marks = labels.where(F.col(key).isNotNull() & F.col("subject").isin(*subjects)).select(F.col(key), number[F.col("subject")].alias("k")).distinct()
    marks = marks.groupBy(key).agg(F.array_sort(F.collect_list("k")).alias("mask"))  # at most one entry a subject
    read = source.mapInArrow(run, schema)
    return read.join(broadcast_if_small(marks), key, "left")


def complement_weights(counts: np.ndarray) -> np.ndarray:
    """Log ratios of each feature's rate inside a subject to its rate in the complement (other subjects and none).

    ``counts`` has a row a bucket and a column a class, the last one for no subject.
    """
    inside, total = counts[:, :-1], counts.sum(axis=1, keepdims=True)
    outside = total - inside
    width = max(1, (total > 0).sum())
    if not total.any():
        return np.zeros(inside.shape, dtype=np.float32)
    rate_in = (inside + SMOOTHING) / (inside.sum(axis=0) + SMOOTHING * width)
    rate_out = (outside + SMOOTHING) / (outside.sum(axis=0) + SMOOTHING * width)
    weights = np.log(rate_in / rate_out) * (total / (total + HALF_TRUST))
    weights[(np.abs(weights) < LEAST_WEIGHT) | (total < 2)] = 0
    return np.clip(weights, -MOST_WEIGHT, MOST_WEIGHT).astype(np.float32)


def segment_posteriors(ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Posterior of each segment over the subjects and none; ``prior`` has a row a segment."""
    if not len(sizes):
        return np.zeros((0, weights.shape[1] + 1), dtype=np.float32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scores = np.add.reduceat(weights[ids], starts, axis=0)
    scores = np.concatenate([scores, np.zeros((len(scores), 1), dtype=scores.dtype)], axis=1) + np.log(prior)
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    return scores / scores.sum(axis=1, keepdims=True)


def document_posteriors(ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray, prior: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Segment posteriors under the document's own mixture, found from a first look at its segments."""
    first = segment_posteriors(ids, sizes, weights, prior[owner])
    mixture = np.zeros_like(prior)
    np.add.at(mixture, owner, first)
    mixture = (mixture + MIXTURE * prior) / (mixture.sum(axis=1, keepdims=True) + MIXTURE)
    return segment_posteriors(ids, sizes, weights, mixture[owner])


def _arrays(batch: pa.RecordBatch, subjects: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and sizes of all segments of a batch, the document of each, and the prior of each."""
    sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
    offsets = batch.column("sizes").offsets.to_numpy()
    per = np.diff(offsets)
    totals = np.diff(np.concatenate([[0], np.cumsum(sizes)])[offsets - offsets[0]])
    parts = [unpack(x, n) for x, n in zip(batch.column("ids").to_pylist(), totals.tolist(), strict=True)]
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(batch.num_rows), per)
    return ids, sizes, owner, label_matrix(batch.column("mask"), subjects)


def label_matrix(column: pa.Array, subjects: int) -> np.ndarray:
    labelled = np.zeros((len(column), subjects), dtype=bool)
    for row, marks in enumerate(column.to_pylist()):
        if marks:
            labelled[row, marks] = True
    return labelled


def priors(labelled: np.ndarray, subjects: int) -> np.ndarray:
    known = labelled.any(axis=1, keepdims=True)
    own = np.where(labelled, PRIOR_LABELLED / np.maximum(labelled.sum(axis=1, keepdims=True), 1), PRIOR_OTHER)
    own = np.where(known, own, PRIOR_LABELLED / subjects)
    return np.concatenate([own, 1 - own.sum(axis=1, keepdims=True)], axis=1)


#: A segment's share in a subject below this is added to the class of no subject.
LEAST_COUNT = 1e-3


def _gather(read: DataFrame, subjects: int, weights: np.ndarray | None) -> np.ndarray:
    """Expected feature counts of each class over all documents; without weights, over the labelled ones.

    A task hands on its counts as (bucket, class, count) where there is any, in single floats: most buckets have
    counts of few classes. Partitions are merged to at most ``GATHER_TASKS`` tasks first, without a shuffle, so that what is
    shuffled is bounded by the model's size, not by the number of tasks.
    """
    shared = read.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BUCKETS, subjects + 1))
        weights = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes, owner, labelled = _arrays(batch, subjects)
            if not len(sizes):
                continue
            prior = priors(labelled, subjects)
            if weights is None:
                known = labelled.any(axis=1)
                share = np.where(known[:, None], prior, 0)[owner]
            else:
                share = document_posteriors(ids, sizes, weights, prior, owner)
                share *= np.where(labelled.any(axis=1), 1.0, UNLABELLED)[owner][:, None]
            # nearly every segment is of one class; the class of no subject is what is left of all
            each = np.repeat(np.arange(len(sizes)), sizes)
            whole = share.sum(axis=1)
            everything = np.bincount(ids, weights=whole[each], minlength=BUCKETS)
            for c in range(subjects):
                some = (share[:, c] > LEAST_COUNT)[each]
                mine = np.bincount(ids[some], weights=share[each[some], c], minlength=BUCKETS) if some.any() else 0
                counts[:, c] += mine
                everything -= mine
            counts[:, -1] += np.maximum(everything, 0)
        rows, classes = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((rows * (subjects + 1) + classes).astype(np.int32)), pa.array(counts[rows, classes].astype(np.float32))], names=["cell", "n"])

    # without weights documents without labels add nothing
    source = read.where(F.col("mask").isNotNull()) if weights is None else read
    parts = source.select("mask", "sizes", "ids").coalesce(GATHER_TASKS).mapInArrow(run, "cell int, n float")
    table = parts.groupBy("cell").agg(F.sum(F.col("n").cast("double")).alias("n")).toArrow()  # at most BUCKETS times the classes
    counts = np.zeros(BUCKETS * (subjects + 1))
    counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return counts.reshape(BUCKETS, subjects + 1)


def evidence(read: DataFrame, key: str, subjects: int, weights: np.ndarray) -> DataFrame:
    """``key, mask, segments, found``: the expected number of segments about each subject."""
    shared = read.sparkSession.sparkContext.broadcast(weights)
    kind = dict(read.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = priors(np.zeros((1, subjects), dtype=bool), subjects)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes, owner, _ = _arrays(batch, subjects)
            share = document_posteriors(ids, sizes, shared.value, np.repeat(flat, batch.num_rows, axis=0), owner)
            found = np.zeros((batch.num_rows, subjects))
            np.add.at(found, owner, share[:, :-1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * subjects), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("mask"), pa.array(np.bincount(owner, minlength=batch.num_rows).astype(np.int32)), lists], names=[key, "mask", "segments", "found"])

    return read.select(key, "mask", "sizes", "ids").mapInArrow(run, f"{key} {kind}, mask array<int>, segments int, found array<double>")


def calibration_features(found: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """What the posterior of a subject rests on: its segments, absolutely and as a share."""
    return np.stack([np.ones_like(found), np.log(found + 0.3), found / np.maximum(segments, 1)], axis=-1)


def fit_logistic(x: np.ndarray, y: np.ndarray, toward: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps; ``ridge`` draws the coefficients to ``toward`` (0)."""
    toward = np.zeros(x.shape[1]) if toward is None else toward
    beta = toward.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * (beta - toward))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_back(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), key), F.lit(HELD)) == 0


def calibrate(found: np.ndarray, segments: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of each subject's own posterior, and the mean log-likelihood of the held labels under them.

    A subject's fit is drawn to that of all subjects together, the less the more documents have it. The likelihood is
    that of two halves, each judged by the other's fit.
    """
    x = calibration_features(found, segments[:, None].astype(float))

    def fit(rows: np.ndarray) -> np.ndarray:
        all_subjects = fit_logistic(x[rows].reshape(-1, x.shape[-1]), labels[rows].ravel().astype(float))
        return np.stack([fit_logistic(x[rows, c], labels[rows, c].astype(float), all_subjects, CALIBRATION_TRUST / max(1.0, labels[rows, c].sum())) for c in range(labels.shape[1])])

    half = np.arange(len(x)) % 2 == 0
    likelihood = []
    for mine in (half, ~half):
        if not mine.any() or mine.all():
            continue
        score = np.einsum("ncf,cf->nc", x[mine], fit(~mine))
        likelihood.append(np.where(labels[mine], -np.logaddexp(0, -score), -np.logaddexp(0, score)).ravel())
    return fit(np.ones(len(x), dtype=bool)), float(np.concatenate(likelihood).mean()) if likelihood else 0.0


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray, DataFrame]:
    """Subject names, feature weights, calibration of each subject, and the evidence of every document.

    Labels of held documents take no part while they tell how many rounds help, and calibrate; the weights are then
    trained anew on all labels with that number of rounds.
    """
    names = [r["subject"] for r in subjects.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").limit(MAX_SUBJECTS + 1).collect()]
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    k = len(names)
    read = cut(read_documents(documents, labels, names, key, text))
    training = read.withColumn("mask", F.when(~held_back(key), F.col("mask")))
    chosen = read.where(F.col("mask").isNotNull() & held_back(key))
    # a fixed order, so that the same documents are halved alike in every round
    held = cut(chosen.orderBy(F.xxhash64(key), key).limit(CALIBRATION_DOCUMENTS))
    usual = np.tile(np.array([-1.5, 1.5, 1.0]), (k, 1))

    def judged(weights: np.ndarray) -> tuple[np.ndarray, float]:
        rows = evidence(held, key, k, weights).select(key, "mask", "segments", "found").toArrow().sort_by(key)
        if rows.num_rows < 2:
            return usual, 0.0
        return calibrate(np.array(rows.column("found").to_pylist()).reshape(-1, k), rows.column("segments").to_numpy(), label_matrix(rows.column("mask").combine_chunks(), k))

    weights = complement_weights(_gather(training, k, None))
    turns, (beta, best) = 0, judged(weights)
    while turns < rounds:
        weights = complement_weights(_gather(training, k, weights))
        new, likelihood = judged(weights)
        # the first round brings in the unlabelled documents; further ones must raise the likelihood
        if turns and likelihood <= best:
            break
        turns, beta, best = turns + 1, new, likelihood
    # as many rounds once more, from all labels
    weights = complement_weights(_gather(read, k, None))
    for _ in range(turns):
        weights = complement_weights(_gather(read, k, weights))
    return names, weights, beta, evidence(read, key, k, weights)


def subject_posteriors(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, subject, posterior`` for every subject of every document whose posterior reaches the threshold.

    Documents without text have no subject; null keys take no part; repeated rows of a document give
    one row a subject (the largest posterior). Labels of unknown documents or subjects, null or
    repeated labels add nothing. Without subjects or documents there are no rows.
    """
    kind = dict(documents.dtypes)[key]
    schema = f"{key} {kind}, subject string, posterior double"
    if subjects.where("subject IS NOT NULL").isEmpty():
        return documents.sparkSession.createDataFrame([], schema)
    names, _, beta, scored = train(documents, labels, subjects, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("found").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            x = calibration_features(found, batch.column("segments").to_numpy(zero_copy_only=False)[:, None].astype(float))
            p = 1 / (1 + np.exp(-np.clip(np.einsum("ncf,cf->nc", x, beta), -30, 30)))
            row, which = np.nonzero(p >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array([names[w] for w in which], type=pa.string()), pa.array(p[row, which])], names=[key, "subject", "posterior"])

    rows = scored.select(key, "segments", "found").mapInArrow(run, schema)
    return rows.groupBy(key, "subject").agg(F.max("posterior").alias("posterior"))
