"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Method. (1) Rows get a place (partition, index) that is written down, so retries can't change it.
(2) The driver draws how many rows each partition sends to each shard: a matrix whose row sums are
the partitions' sizes and whose column sums are the shards' sizes, each line multivariate hypergeometric
given those before. (3) A keyed bijection permutes each partition's indexes; consecutive ranges of the
permuted index go to the shards by the matrix's line. (4) The exchange. (5) A second keyed bijection
permutes each shard's slots.

Counts, not rows, reach the driver: one number for each partition and partition x shards in the
matrix. A row's shard and slot are functions of its place alone, so there is no sort, no group and no hot
key, and the exchange deals even blocks of slots.

Defined results: sizes differ by at most one row, the first shards having the extra row. Null text has no
bytes. Nulls, repeated identifiers and repeated rows are rows like any other, and extra columns pass.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WorkArea, fresh_name
from .wordhash import mix

_NUMPY_MOST = 10**9 - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good + bad`` are good. Exact inverse transform from the mode where NumPy has no sampler."""
    if not good or not draws:
        return 0
    if not bad or draws == good + bad:
        return min(good, draws)
    if good + bad <= _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    log = math.lgamma
    choose = lambda n, k: log(n + 1) - log(k + 1) - log(n - k + 1)
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, up, down, pu, pd = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Rows sent from each partition to each shard."""
    rng = np.random.default_rng(seed)
    left = list(map(int, shard_sizes))
    out = np.zeros((len(sizes), len(left)), dtype=np.int64)
    for i, n in enumerate(sizes):
        need, rest = int(n), sum(left)
        for k in range(len(left)):
            rest -= left[k]
            got = hypergeometric(rng, left[k], rest, need)
            out[i, k] = got
            need -= got
        for k in range(len(left)):
            left[k] -= int(out[i, k])
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of [0, size) for each element: a Feistel network on the next even power of two, walked back into range."""
    half = np.maximum(1, (np.frexp(np.maximum(size - 1, 1).astype(np.float64))[1] + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.ones(len(index), dtype=bool)
    while todo.any():
        v, h, m, k = value[todo], half[todo], mask[todo], key[todo]
        left, right = v >> h, v & m
        for r in range(4):
            left, right = right, left ^ (mix(right ^ mix(k + np.uint64(r))) & m)
        value[todo] = (left << h) | right
        todo[todo] = value[todo] >= size[todo].astype(np.uint64)
    return value.astype(np.int64)


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 7, place: tuple[str, ...] | None = None, area: WorkArea | None = None) -> DataFrame:
    """``docs`` (the columns in ``place``, default all) with ``shard`` int and ``slot`` long, exchanged.

    Columns with these two names are replaced. Rows of a shard have slots 0 to its size - 1, dealt over the exchange's partitions in blocks of slots.
    """
    if shards < 1:
        raise ValueError("shards is at least 1")
    spark = docs.sparkSession
    area = area or WorkArea(spark, "sharding")
    shard, slot = "shard", "slot"
    names = [c for c in place or docs.columns if c.lower() not in (shard, slot)]
    part, idx = (fresh_name(names, x) for x in ("part", "idx"))
    row = F.monotonically_increasing_id()  # partition in the high 31 bits, index in the low 33
    placed = docs.select(*names, row.alias(idx)).withColumns({part: F.shiftright(idx, 33), idx: F.col(idx).bitwiseAND((1 << 33) - 1)})
    placed = area.table(placed, "placed")
    sizes = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}  # one number for each partition
    parts = sorted(sizes)
    total = sum(sizes.values())
    shard_sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([sizes[p] for p in parts], shard_sizes, seed)
    ends, before = matrix.cumsum(axis=1), np.vstack([np.zeros((1, shards), np.int64), matrix.cumsum(axis=0)[:-1]]) if parts else matrix
    number = np.array(parts, dtype=np.int64)
    counts, targets = np.array([sizes[p] for p in parts], dtype=np.int64), np.array(shard_sizes, dtype=np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.searchsorted(number, batch.column(part).to_numpy(zero_copy_only=False))
            i = batch.column(idx).to_numpy(zero_copy_only=False)
            key = mix(p.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B1))
            at = permute(i, counts[p], key)
            to = (at[:, None] >= ends[p]).sum(axis=1)
            offset = at - np.where(to > 0, ends[p, np.maximum(to - 1, 0)], 0) + before[p, to]
            key = mix(to.astype(np.uint64) ^ np.uint64(0xA5A5A5A5) + np.uint64(seed))
            cols = [batch.column(n) for n in names] + [pa.array(to.astype(np.int32)), pa.array(permute(offset, targets[to], key))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, shard, slot])

    schema = placed.select(*names, F.lit(0).alias(shard), F.lit(0).cast("long").alias(slot)).schema
    out = placed.select(*names, part, idx).mapInArrow(assign, schema)
    return out.repartition(F.col(shard), F.shiftright(slot, 12))
