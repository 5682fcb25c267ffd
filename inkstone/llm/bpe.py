"""Byte-level BPE encoding of a whole corpus (problem 7).

Merging follows the tokenizer's rule - always the leftmost pair of least rank - with one segment
tree per piece. The leaf of a byte position holds ``rank << SHIFT | position`` of the pair that
starts there, so the root is the leftmost least pair. A merge rewrites the leaves of the merged
position, of the swallowed neighbour and of the live position before, each by a walk to the root.
Trees of pieces of like length lie side by side in one array, so each round does one merge in every
unfinished piece of the batch with a few numpy calls. Pieces that come again are looked up.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern published with the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers before it forgets all; a bound on memory, without effect on results.
MEMO_PIECES = 200_000
#: Bytes of texts whose unseen pieces are merged in one round of trees; a bound on memory only.
ROUND_BYTES = 4_000_000
INF = np.int64(2**62)
SHIFT = np.int64(40)
LOW = np.int64(2**40 - 1)


class Encoder:
    """The vocabulary at ``path`` (lines of base64 token and rank) with its pair table."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.memo: dict[str, list[int]] = {}
        keys, values = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._build_table(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build_table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled round by round."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.size = 1 << self.bits
        self.table_keys = np.full(self.size, -1, dtype=np.int64)
        self.table_values = np.full(self.size, INF, dtype=np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.table_keys[at[todo]] == -1
            first = todo[free][np.unique(at[todo][free], return_index=True)[1]]
            self.table_keys[at[first]], self.table_values[at[first]] = keys[first], values[first]
            todo = todo[self.table_keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) % self.size

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._slot(keys)
        found = self.table_keys[at]
        out = np.where(found == keys, self.table_values[at], INF)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) % self.size
            found = self.table_keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.table_values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def merge_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece; pieces of like length share an array of segment trees."""
        out: list[list[int]] = [[] for _ in pieces]
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if piece:
                classes.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(k)
        for bits, members in classes.items():
            step = max(1, (1 << 20) >> bits)
            for a in range(0, len(members), step):
                block = members[a : a + step]
                for k, ids in zip(block, self._merge_block([pieces[k] for k in block], 1 << bits), strict=True):
                    out[k] = ids
        return out

    def _merge_block(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        inside = np.arange(width)[None, :] < length[:, None]
        token = np.full((n, width + 1), -1, dtype=np.int64)
        token[:, :width][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        following = np.minimum(np.arange(1, width + 2)[None, :], length[:, None]).astype(np.int64)
        before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        tree = np.full((n, 2 * width), INF, dtype=np.int64)
        row, pos = np.nonzero(np.arange(width)[None, :] < length[:, None] - 1)
        rank = self.pair_ranks(token[row, pos], token[row, pos + 1])
        tree[row, width + pos] = np.where(rank < INF, rank << SHIFT | pos, INF)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        # views as flat arrays: one index computation instead of two
        flat_tree, flat_token, flat_next, flat_before = tree.ravel(), token.ravel(), following.ravel(), before.ravel()
        rows = np.arange(n)
        while True:
            root = flat_tree[rows * (2 * width) + 1] if width > 1 else flat_tree[rows * 2 + 1]
            live = root < INF
            rows, root = rows[live], root[live]
            if not len(rows):
                break
            base, tree_base = rows * (width + 1), rows * (2 * width) + width
            i, merged = root & LOW, root >> SHIFT
            j = flat_next[base + i]
            k = flat_next[base + j]
            flat_token[base + i] = merged
            flat_next[base + i] = k
            flat_before[base + k] = i
            h = flat_before[base + i]
            end = length[rows]
            # leaves of the merged position, the swallowed one, the live one before
            right = np.full(len(rows), INF, dtype=np.int64)
            has = k < end
            right[has] = self.pair_ranks(merged[has], flat_token[(base + k)[has]])
            left = np.full(len(rows), INF, dtype=np.int64)
            had = h >= 0
            left[had] = self.pair_ranks(flat_token[(base + h)[had]], merged[had])
            flat_tree[tree_base + j] = INF
            flat_tree[tree_base + i] = np.where(right < INF, right << SHIFT | i, INF)
            flat_tree[(tree_base + h)[had]] = np.where(left < INF, left << SHIFT | h, INF)[had]
            touched = np.concatenate([width + j, width + i, (width + h)[had]])
            owner = np.concatenate([rows, rows, rows[had]]) * (2 * width)
            for _ in range(width.bit_length() - 1):
                touched >>= 1
                child = owner + 2 * touched
                flat_tree[owner + touched] = np.minimum(flat_tree[child], flat_tree[child + 1])
        ids = []
        for r in range(n):
            at, one, end = 0, [], int(length[r])
            follow, tokens = following[r], token[r]
            while at < end:
                one.append(int(tokens[at]))
                at = int(follow[at])
            ids.append(one)
        return ids

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids without special tokens; null and empty texts give an empty list."""
        out: list[list[int]] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size < ROUND_BYTES):
                size += len(texts[end] or "")
                end += 1
            split = [self.find(t) if t else [] for t in texts[start:end]]
            if len(self.memo) > MEMO_PIECES:
                self.memo.clear()
            memo = self.memo
            unseen: dict[str, None] = {}
            for pieces in split:
                for p in pieces:
                    if p not in memo:
                        unseen[p] = None
            if unseen:
                names = list(unseen)
                for p, ids in zip(names, self.merge_pieces([p.encode("utf-8", "surrogatepass") for p in names]), strict=True):
                    memo[p] = ids
            for pieces in split:
                ids: list[int] = []
                for p in pieces:
                    ids += memo[p]
                out.append(ids)
            start = end
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for ``path``, read from the copy that was sent along with the job."""
    if path not in _ENCODERS:
        # outside a job there is nothing sent
        sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._is_running_on_worker else path
        _ENCODERS[path] = Encoder(sent if os.path.exists(sent) else path)
    return _ENCODERS[path]


def send(df: DataFrame, path: str) -> None:
    """Sends the vocabulary to the executors, which need not have it; where the driver does not have it, the executors must."""
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key, ids`` for every row: the token ids of ``text`` without special tokens.

    Null and empty texts give an empty list, null keys are kept, repeated rows give repeated rows,
    other columns are not read. No shuffle.
    """
    send(df, vocabulary)
    source = df.select(key, text)
    schema = T.StructType([source.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_batch
        for batch in batches:
            ids = encode(batch.column(1).to_pylist())
            lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            flat = np.fromiter((x for one in ids for x in one), dtype=np.int32, count=int(lengths.sum()))
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int32)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=[key, "ids"])

    return source.mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` columns and ``tokens``, the number of token ids of ``text`` (0 for null and empty)."""
    send(df, vocabulary)
    source = df.select(*keep, text)
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_batch
        for batch in batches:
            counts = pa.array([len(x) for x in encode(batch.column(len(keep)).to_pylist())], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, "tokens"])

    return source.mapInArrow(run, schema)
