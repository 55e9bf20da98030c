"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Method. A pre-token's bytes form a linked list of parts. Each pair of neighbours whose joined
bytes have a merge rank is queued in that rank's bucket by the position of its left part. A
three-level bitmap marks the buckets in use; find-first-set walks its three words to the lowest rank.
That bucket's positions are merged in order; entries whose parts have changed meanwhile are stale and
are skipped when they surface. Cost is near-linear in the pre-token's length, so a pre-token of
megabytes is no special case. The result is that of always merging the leftmost pair of lowest rank.

Ids of pre-tokens met before come from a bounded cache in each worker, by the pre-token itself; one queue serves all the others of
a group of texts at once. Equal pre-tokens of a group are found by hashes and compared by their text.
Text is split by the tokenizer's own pattern, whole, without special tokens.
The pattern is evaluated over arrays of code points rather than by a regex engine.

Defined results: a null or empty text has no ids; decoding gives back the text's exact bytes. Text
is what Spark holds, valid UTF-8. Extra columns don't matter; rows are independent, so repeated rows,
null identifiers and empty tables need no rule.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import bound_batches
from .wordhash import slices, span_hashes

_CACHE_ENTRIES = 1 << 18  # about 80 MB
_LARGE_BUCKET = 64  # positions from which a bucket is merged by array operations
_CACHE_LONGEST = 64  # characters of a pre-token that is worth keeping


class RankQueue:
    """Buckets of positions by merge rank, under a bitmap of three levels of 64-bit words."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self, ranks: int) -> None:
        words = (ranks >> 6) + 1
        self.low, self.mid, self.top = [0] * words, [0] * ((words >> 6) + 1), 0
        if len(self.mid) > 64:
            raise ValueError("three levels hold at most 262,144 ranks")
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        """Open the bucket of a rank that has none."""
        self.buckets[rank] = positions
        w, m = rank >> 6, rank >> 12
        self.low[w] |= 1 << (rank & 63)
        self.mid[m] |= 1 << (w & 63)
        self.top |= 1 << m

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank in use, by find-first-set on each level, and its bucket, which is closed."""
        m = (self.top & -self.top).bit_length() - 1
        mid = self.mid[m]
        w = (m << 6) | ((mid & -mid).bit_length() - 1)
        low = self.low[w]
        rank = (w << 6) | ((low & -low).bit_length() - 1)
        low &= low - 1
        self.low[w] = low
        if not low:
            mid &= mid - 1
            self.mid[m] = mid
            if not mid:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)

    def __bool__(self) -> bool:
        return bool(self.top)


class Encoder:
    """``tokens[id]`` are an id's bytes; ids are merge ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        most = max(ranks.values(), default=0)
        self.tokens: list[bytes] = [b""] * (most + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(most)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes {missing[:5]}")
        self._single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self._pair = np.full(1 << 16, -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self._pair[token[0] << 8 | token[1]] = rank
        joins = []
        self._delicate: set[int] = set()  # ranks whose merge can queue a lower rank
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    joins.append((a << 32 | b, rank))
                    self._delicate.update(x for x in (a, b) if x > rank)
        joins.sort()
        self._join_keys = np.array([k for k, _ in joins] or [-1], dtype=np.int64)
        self._join_ranks = np.array([r for _, r in joins] or [-1], dtype=np.int64)

    def _queue_pairs(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> None:
        """Queue the neighbours (left, right) that have a rank."""
        keys = ids[left] << 32 | ids[right]
        at = np.minimum(np.searchsorted(self._join_keys, keys), len(self._join_keys) - 1)
        found = self._join_keys[at] == keys
        left, new = left[found], self._join_ranks[at[found]]
        order = np.argsort(new, kind="stable")
        left, new = left[order].tolist(), new[order]
        edges = [*(np.flatnonzero(np.diff(new)) + 1).tolist(), len(left)]
        buckets, put, a = self.queue.buckets, self.queue.put, 0
        for b, rank in zip(edges, new[[e - 1 for e in edges]].tolist() if left else [], strict=False):
            if rank in buckets:
                buckets[rank].extend(left[a:b])
            else:
                put(rank, left[a:b])
            a = b

    def _merge_bucket(self, rank: int, bucket: list[int], end: np.ndarray, before: np.ndarray, ids: np.ndarray) -> None:
        """All merges of a large bucket at once. Where two entries overlap, the left one goes first, as one by one."""
        i = np.unique(np.array(bucket))
        i = i[end[i] > 0]
        middle = end[i]
        stop = end[middle]
        good = stop - i == len(self.tokens[rank])
        i, middle, stop = i[good], middle[good], stop[good]
        if not len(i):
            return
        chained = np.append(False, i[1:] == middle[:-1])
        if chained.any():
            run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(i))))
            odd = (np.arange(len(i)) - run) & 1 == 0
            i, middle, stop = i[odd], middle[odd], stop[odd]
        end[i], ids[i] = stop, rank
        end[middle] = 0
        right = end[stop] > 0
        before[stop[right]] = i[right]
        self._queue_pairs(i[right], stop[right], ids)
        left = before[i]
        own = left >= 0
        self._queue_pairs(left[own], i[own], ids)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in order, ids of each).

        The pre-tokens lie end to end with a dead byte after each, so one queue serves them all and a bucket
        is emptied in one go. If a merge queues a rank below the bucket's, the rest of the bucket goes
        back first: within each pre-token the lowest rank, leftmost, is always next.
        """
        text = b"\0".join([*pieces, b""])
        raw = np.frombuffer(text, dtype=np.uint8)
        n = len(raw)
        gaps = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        end, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        end[gaps] = 0  # 0: no part starts here
        before[gaps[:-1] + 1] = -1
        first = self._pair[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        first[gaps[:-1]] = -1
        first[gaps[gaps > 0] - 1] = -1
        live = np.flatnonzero(first >= 0)
        live = live[np.argsort(first[live], kind="stable")]
        ranks, at = np.unique(first[live], return_index=True)
        queue, get, tokens = self.queue, self.ranks.get, self.tokens
        for rank, bucket in zip(ranks.tolist(), np.split(live, at[1:]), strict=False):
            queue.put(rank, bucket.tolist())
        all_end, all_before, all_ids = end, before, self._single[raw]
        end, before, ids = memoryview(all_end), memoryview(all_before), memoryview(all_ids)  # single items are faster this way
        buckets, put = queue.buckets, queue.put
        while queue:
            rank, bucket = queue.take()
            if len(bucket) >= _LARGE_BUCKET and rank not in self._delicate:
                self._merge_bucket(rank, bucket, all_end, all_before, all_ids)
                continue
            bucket.sort()
            size = len(tokens[rank])
            for k, i in enumerate(bucket):
                middle = end[i]
                if not middle:
                    continue  # stale: the part was merged into the one before
                stop = end[middle]
                if stop - i != size:
                    continue  # stale: one of the parts has grown
                end[i], end[middle], ids[i] = stop, 0, rank
                lowest = rank
                after = end[stop]
                if after:
                    before[stop] = i
                    new = get(text[i:after])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            put(new, [i])
                        lowest = new
                left = before[i]
                if left >= 0:
                    new = get(text[left:stop])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            put(new, [left])
                        if new < lowest:
                            lowest = new
                if lowest < rank and k + 1 < len(bucket):
                    put(rank, bucket[k + 1 :])
                    break
        alive = all_end > 0
        return all_ids[alive].astype("<u4"), np.diff(np.cumsum(alive)[gaps], prepend=0)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: Fixed value: the pattern that :func:`token_starts` implements over whole arrays of code points.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[_WHITE] = _SPACE
    return out


def token_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts laid end to end: the matches of :data:`PATTERN`, found without a regex engine.

    Runs of one class are tokens; a space before a run of another class belongs to it; of white space before
    something else, all but the last character is one token; an apostrophe that begins a token takes
    one of the seven endings.
    """
    n = len(points)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[text_starts] = True
    edge[n] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    after_white = np.flatnonzero(start[1:] & ~edge[1:n] & (kind[:-1] == _SPACE)) + 1
    start[after_white - 1] = True
    start[after_white[points[after_white - 1] == 32]] = False
    quote = np.flatnonzero(start & (points == 39))
    quote = quote[~edge[quote + 1]]
    one = quote[np.isin(points[quote + 1], [ord(c) for c in "stmd"])]
    two = quote[~edge[np.minimum(quote + 2, n)]]
    pair = points[two + 1].astype(np.int64) << 32 | points[two + 2]
    two = two[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    start[one + 1] = False
    start[two + 1] = False
    start[(one + 2)[one + 2 < n]] = True
    start[(two + 3)[two + 3 < n]] = True
    return np.flatnonzero(start)


def _cuts(text: str, most: int) -> list[str]:
    """A long text in pieces that end before a space after a non-space, where a pre-token always begins."""
    out, at = [], 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most)
        if not found:
            break
        out.append(text[at : found.start() + 1])
        at = found.start() + 1
    return [*out, text[at:]]


_CUT = re.compile(r"\S ")  # any \S of Python's is not white space in the pattern either
_PIECE = 1 << 20


def _apart(points: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal hashes, checked on the text: a span that differs from its group's first goes to a group of its own text."""
    sizes = stops - starts
    odd = sizes != sizes[first][which]
    same = np.flatnonzero(~odd)
    n = sizes[same]
    at = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(at, n)
    differs = points[inside + np.repeat(starts[same], n)] != points[inside + np.repeat(starts[first][which[same]], n)]
    odd[same] = np.add.reduceat(differs, at) > 0 if len(at) else False
    if odd.any():
        groups: dict[bytes, int] = {}
        first, which = first.tolist(), which.copy()
        for i in np.flatnonzero(odd).tolist():
            own = points[starts[i] : stops[i]].tobytes()
            if own not in groups:
                groups[own] = len(first)
                first.append(i)
            which[i] = groups[own]
        first = np.array(first)
    return first, which


class _Worker:
    """One encoder and cache for all tasks of a Python worker."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(read_ranks(path))
        self.cache: dict[str, bytes] = {}
        tokens = self.encoder.tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text) for texts of bounded length together."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum(sizes)
        starts = token_starts(points, (ends - sizes)[sizes > 0])
        stops = np.append(starts[1:], len(points))
        _, first, which = np.unique(span_hashes(points, starts, stops), return_index=True, return_inverse=True)
        first, which = _apart(points, starts, stops, first, which)
        cache, merge = self.cache, self.encoder.merge
        if len(cache) + len(first) > _CACHE_ENTRIES + len(first) // 2:
            cache.clear()
        kinds = [joined[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        own = [cache.get(kind) for kind in kinds]
        new = [k for k, got in enumerate(own) if got is None]
        if new:
            merged, per = merge([kinds[k].encode() for k in new])
            to = np.cumsum(per).tolist()
            merged, a = merged.tobytes(), 0
            for k, b in zip(new, to, strict=True):
                own[k] = merged[4 * a : 4 * b]
                if len(kinds[k]) <= _CACHE_LONGEST:
                    cache[kinds[k]] = own[k]
                a = b
        flat = np.frombuffer(b"".join(own), dtype="<u4")
        per = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        at = np.cumsum(per) - per
        each = per[which]
        total = np.cumsum(each)
        ids = flat[np.repeat(at[which] - (total - each), each) + np.arange(total[-1])]
        tokens_to = np.searchsorted(starts, ends, side="left")
        return ids, np.diff(np.append(0, total)[tokens_to], prepend=0)

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; texts go through in groups of about a million characters."""
        group: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > _PIECE:
                yield from self._split(group)
                group, size = [], 0
                yield np.concatenate([self._ids([piece])[0] for piece in _cuts(text, _PIECE)])
                continue
            if size + len(text) > _PIECE:
                yield from self._split(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        yield from self._split(group)

    def _split(self, group: list[str]) -> Iterator[np.ndarray]:
        if group:
            ids, counts = self._ids(group)
            yield from np.split(ids, np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        out = []
        for at in range(0, len(ids), 1 << 20):
            part = ids[at : at + (1 << 20)]
            size = self.lengths[part]
            to = np.cumsum(size)
            out.append(self.pool[np.repeat(self.offsets[part] - (to - size), size) + np.arange(to[-1])].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def _worker(name: str) -> _Worker:
    return _Worker(SparkFiles.get(name))


def _ship(df: DataFrame, ranks_path: str) -> str:
    """Send the rank file (under 1 MB) to every executor; returns its name there."""
    bound_batches(df.sparkSession)
    df.sparkSession.sparkContext.addFile(ranks_path)
    return ranks_path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``: binary, the ids as little-endian unsigned 32-bit integers. A column of that name is replaced."""
    docs = docs.drop(out_col)
    name, names = _ship(docs, ranks_path), docs.columns
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField(out_col, T.BinaryType())])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(name)
        for batch in batches:
            for piece in slices(batch, text_col):
                ids = [x.astype("<u4").tobytes() for x in worker.ids(piece.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(ids, pa.binary())], names=[*names, out_col])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``: binary, the bytes that the ids stand for. A column of that name is replaced."""
    encoded = encoded.drop(out_col)
    name, names = _ship(encoded, ranks_path), encoded.columns
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in encoded.schema), T.StructField(out_col, T.BinaryType())])
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _worker(name).decode
        for batch in batches:
            out = [back(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, out_col])

    return encoded.mapInArrow(run, schema)


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and return digests of both: the ids never leave the worker."""
    name = _ship(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(name)
        sha = hashlib.sha256
        for batch in batches:
            for piece in slices(batch, "text"):
                counts, a, b = [], [], []
                for ids in worker.ids(piece.column(1).to_pylist()):
                    counts.append(len(ids))
                    a.append(sha(ids.astype("<u4").tobytes()).hexdigest())
                    b.append(sha(worker.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(counts, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, DIGEST_SCHEMA)
