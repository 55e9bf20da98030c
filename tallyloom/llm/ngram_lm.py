"""Interpolated modified Kneser-Ney language model, counted in Spark and memory-mapped by the workers.

Method. Each task turns its texts into 64-bit word values and pre-aggregates its bigrams; sorted
blocks of (context, word, count) are exchanged by a hash of the bigram, so that a context that a third of the text has is
spread over all shards. Each shard merges the blocks, writes its bigrams as a sorted hash array and emits
two partial sums for each word: the number of contexts it follows, and as a context how many words
follow it once, twice, or more. A bigram is in one shard alone, so these sums add up. A second exchange by word adds the word's own count and writes the
word table. Count-of-counts give the discounts. Scoring maps the files into memory: a batch's distinct
words and bigrams are sorted and looked up by binary search in the arrays.

p(w|h) = max(c(h,w) - D(c), 0)/c(h) + g(h) p(w);  p(w) = max(a(w) - D'(a), 0)/A + g' / (V + 1), where a(w) is
the number of distinct contexts before w and V the number of distinct words. Unknown words get
the last term, so the probabilities of a context add up to one over known words plus one unknown.

The order is two: on text whose longer word runs are nearly all unique, a trigram table is as long
as the corpus. A bigram's stored key is its shard, 16 bits of bucket and 32 bits of remainder; seen bigrams that share these are listed
with whole keys, and a bigram that was not seen is taken for another with a chance of about 1 in 10**8. Words and bigrams are told apart by 64 bits.

Model size follows the corpus: 5 bytes a distinct bigram. A file is at most a shard's bigrams. Where the shared
folder is a local mount, files are mapped in place; elsewhere a worker fetches them to an unlinked temporary file first.

Defined results. Null text is empty and scores its end token alone. Repeated rows count as often as they
occur; a null id is hashed as the empty string. With no training rows every score is log10(1/(V+1)) = 0 per token.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WorkArea, text_bytes
from .wordhash import mix, slices, words

#: Values of the end and begin marks: no word has them but by a 64-bit coincidence.
END, BEGIN = np.uint64(0x454E44), np.uint64(0x424547)
_BLOCK_TOKENS = 6 << 20  # tokens that a task gathers before it pre-aggregates
_SCORE_TOKENS = 2 << 20
_BUCKETS = 1 << 16


def _with_ends(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with an end after each text; the context of each token."""
    per = counts + 1
    last = np.cumsum(per) - 1
    tokens = np.empty(per.sum(), np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[last] = True
    tokens[is_end] = END
    tokens[~is_end] = values
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[last - per + 1] = BEGIN
    return tokens, context


def _merge(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of each value."""
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(np.concatenate(v)[order].astype(np.int64), first) if len(key) else np.zeros(0, np.int64) for v in values)


def _pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as single bytes; those of 255 and more also as (index, count) pairs."""
    big = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), np.stack([big, counts[big]]).astype("<i8").tobytes()


def _unpack(small: bytes, big: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    at, value = np.frombuffer(big, "<i8").reshape(2, -1)
    out[at] = value
    return out


def _shard_of(value: np.ndarray, shards: int) -> np.ndarray:
    return (mix(value ^ np.uint64(0x5DEECE66D)) % np.uint64(shards)).astype(np.int64)


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))


def _write(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another, 64-byte aligned, after a line that names them. A retry replaces the file whole."""
    head, at, body = [], 0, io.BytesIO()
    for name, a in arrays.items():
        head.append(f"{name} {a.dtype.str} {len(a)} {at}")
        raw = a.tobytes()
        body.write(raw + b"\0" * (-len(raw) % 64))
        at += len(raw) + (-len(raw) % 64)
    line = ";".join(head).encode()
    system, path = _file_system(uri)
    own = f"{path}.{os.getpid()}.part"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(own) as f:
        f.write(line.ljust(448) + b"\n" + b"\0" * 63)
        f.write(body.getbuffer())
    system.move(own, path)


def _map(uri: str) -> dict[str, np.ndarray]:
    system, path = _file_system(uri)
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as f:
            with system.open_input_stream(path) as source:
                while block := source.read(8 << 20):
                    f.write(block)
            f.flush()
            raw = np.memmap(f, np.uint8, "r")
    out = {}
    for part in bytes(raw[:448]).decode().strip().split(";"):
        name, kind, n, at = part.split(" ")
        at, size = 512 + int(at), int(n) * np.dtype(kind).itemsize
        out[name] = raw[at : at + size].view(kind)
    return out


def _count_blocks(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(tokens: list[np.ndarray], contexts: list[np.ndarray], docs: int) -> Iterator[pa.RecordBatch]:
        token, context = np.concatenate(tokens), np.concatenate(contexts)
        names, c = np.unique(context, return_inverse=True)
        ends, w = np.unique(token, return_inverse=True)
        pair = np.sort(c.astype(np.int64) << 32 | w)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        n = np.diff(np.append(first, len(pair)))
        pair = pair[first]
        c, w = names[pair >> 32], ends[pair & 0xFFFFFFFF]
        to = _shard_of(_key(c, w), shards)
        order = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[order], np.arange(shards + 1))
        rows: dict[str, list] = {k: [] for k in ("shard", "contexts", "lengths", "words", "small", "big", "docs")}
        for s in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[s] : edge[s + 1]]
            own = c[at]
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            small, big = _pack(n[at])
            lengths = np.diff(np.append(start, len(own)))
            for k, v in zip(rows, (s, own[start].tobytes(), lengths.astype("<u4").tobytes(), w[at].tobytes(), small, big, 0), strict=True):
                rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, contexts, size = [], [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                t, c = _with_ends(*words(piece.column("text")))
                tokens.append(t)
                contexts.append(c)
                size += len(t)
                if size >= _BLOCK_TOKENS:
                    yield from flush(tokens, contexts, 0)
                    tokens, contexts, size = [], [], 0
        if size:
            yield from flush(tokens, contexts, 0)

    return run


_BLOCKS = pa.schema([("shard", pa.int32()), ("contexts", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()), ("small", pa.binary()), ("big", pa.binary()), ("docs", pa.int64())])
_BLOCKS_SQL = "shard int, contexts binary, lengths binary, words binary, small binary, big binary, docs long"
_WORDS = pa.schema([("shard", pa.int32()), ("words", pa.binary()), *((k, pa.binary()) for k in ("tokens", "before", "one", "two", "more")), ("counts", pa.list_(pa.int64()))])
_WORDS_SQL = "shard int, words binary, tokens binary, before binary, one binary, two binary, more binary, counts array<bigint>"
_FIELDS = ("tokens", "before", "one", "two", "more")


def _key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context) + word)


def _merge_shard(root: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cs, ws, ns, shard = [], [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                shard = row["shard"]
                lengths = np.frombuffer(row["lengths"], "<u4")
                cs.append(np.repeat(np.frombuffer(row["contexts"], np.uint64), lengths))
                ws.append(np.frombuffer(row["words"], np.uint64))
                ns.append(_unpack(row["small"], row["big"]))
        context, word, n = np.concatenate(cs), np.concatenate(ws), np.concatenate(ns)
        del cs, ws, ns
        key = _key(context, word)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.add.reduceat(n[order], first)
        key, context, word = key[first], context[order[first]], word[order[first]]
        bucket = np.searchsorted(key >> np.uint64(48), np.arange(_BUCKETS + 1, dtype=np.uint64)).astype("<u4")
        big = np.flatnonzero(n >= 255)
        short = key >> np.uint64(16)
        alike = np.append(False, short[1:] == short[:-1])
        alike |= np.append(alike[1:], False)  # keys that the stored bits don't tell apart
        _write(f"{root}/bigrams-{shard:05d}", {
            "bucket": bucket, "rest": short.astype("<u4"), "small": np.minimum(n, 255).astype(np.uint8), "big_at": big.astype("<u4"), "big": n[big].astype("<i8"),
            "alike": key[alike], "alike_n": n[alike].astype("<i8"),
        })
        ones = np.ones_like(n)
        w, before = _merge([word], [ones])
        _, tokens = _merge([word], [n])
        c, one, two, more = _merge([context], [(n == 1) * 1], [(n == 2) * 1], [(n >= 3) * 1])
        zero = lambda a: np.zeros(len(a), np.int64)
        words_, *sums = _merge([w, c], [tokens, zero(c)], [before, zero(c)], [zero(w), one], [zero(w), two], [zero(w), more])
        counts = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        to = _shard_of(mix(words_), shards)
        order = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[order], np.arange(shards + 1))
        rows: dict[str, list] = {k: [] for k in _WORDS.names}
        for s in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[s] : edge[s + 1]]
            values = (s, words_[at].tobytes(), *(_narrow(x[at]) for x in sums), counts)
            for k, v in zip(rows, values, strict=True):
                rows[k].append(v)
            counts = [0, 0, 0, 0]  # once for each shard
        yield pa.RecordBatch.from_pydict(rows, schema=_WORDS)

    return run


def _narrow(a: np.ndarray) -> bytes:
    """The smallest unsigned width that holds all, which the length tells."""
    top = int(a.max(initial=0))
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _widen(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


def _merge_words(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, counts, shard = [], {k: [] for k in _FIELDS}, np.zeros(4, np.int64), None
        for batch in batches:
            for row in batch.to_pylist():
                shard = row["shard"]
                keys.append(np.frombuffer(row["words"], np.uint64))
                for k in _FIELDS:
                    sums[k].append(_widen(row[k], len(keys[-1])))
                counts += np.array(row["counts"], np.int64)
        key, *got = _merge(keys, *sums.values())
        _write(f"{root}/words-{shard:05d}", {"word": key} | {k: v.astype("<i8") for k, v in zip(_FIELDS, got, strict=True)})
        tokens, before = got[0], got[1]
        seen = tokens > 0
        stats = [int(tokens.sum()), int(seen.sum()), int(before.sum())] + [int((before == k).sum()) for k in (1, 2, 3, 4)] + counts.tolist()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in stats], names=_STATS)

    return run


_STATS = ["tokens", "types", "bigrams", *(f"before{k}" for k in (1, 2, 3, 4)), *(f"n{k}" for k in (1, 2, 3, 4))]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The modified discounts for counts 0, 1, 2 and 3 or more, from counts of counts; 0.5 each where those are too few."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


class Model:
    """A trained model: a folder of sorted hash arrays and a few totals."""

    def __init__(self, root: str, shards: int, totals: dict[str, int]) -> None:
        self.root, self.shards, self.totals = root, shards, totals


def train(docs: DataFrame, text_col: str = "text", area: WorkArea | None = None, shard_bytes: int = 16 << 20) -> Model:
    """Count, smooth and store. The number of shards follows the estimated size of the input."""
    area = area or WorkArea(docs.sparkSession, "ngram-lm")
    shards = max(8, -(-text_bytes(docs, text_col) // shard_bytes))
    root = area.path("model")
    blocks = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_blocks(shards), _BLOCKS_SQL)
    by_context = _per_shard(blocks, shards, _merge_shard(root, shards), _WORDS_SQL)
    stats = _per_shard(by_context, shards, _merge_words(root), ", ".join(f"{k} long" for k in _STATS))
    sums = stats.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in _STATS)).first().asDict()
    return Model(root, shards, sums)


def _per_shard(df: DataFrame, shards: int, merge, schema: str) -> DataFrame:
    """Run ``merge`` on the blocks of each shard, one task a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group = None, []
        for batch in batches:
            own = batch.column(0).to_numpy()
            for a, b in _runs(own):
                if own[a] != shard and group:
                    yield from merge(iter(group))
                    group = []
                shard = own[a]
                group.append(batch.slice(a, b - a))
        if group:
            yield from merge(iter(group))

    return df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(run, schema)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(values):
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist()
        yield from zip(first, [*first[1:], len(values)], strict=True)


@lru_cache(maxsize=1)
def _mapped(root: str, shards: int) -> tuple[list, list]:
    """The model's files, mapped; a shard without words or bigrams has none."""
    def each(kind: str) -> list:
        out = []
        for s in range(shards):
            try:
                out.append(_map(f"{root}/{kind}-{s:05d}"))
            except FileNotFoundError:
                out.append(None)
        return out

    return each("words"), each("bigrams")


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.words, self.bigrams = _mapped(model.root, model.shards)
        t, self.shards = model.totals, model.shards
        self.total, self.types = t["tokens"], t["types"]
        self.high = _discounts(t["n1"], t["n2"], t["n3"], t["n4"])
        low = [t[f"before{k}"] for k in (1, 2, 3, 4)]
        self.low = _discounts(*low)
        self.all_before = t["bigrams"]
        three = self.types - low[0] - low[1]
        self.low_left = (self.low[1] * low[0] + self.low[2] * low[1] + self.low[3] * three) / self.all_before if self.all_before else 1.0

    def word_stats(self, kinds: np.ndarray) -> dict[str, np.ndarray]:
        """The word table's numbers for sorted distinct words; zeros for unknown ones."""
        out = {k: np.zeros(len(kinds), np.int64) for k in _FIELDS}
        to = _shard_of(mix(kinds), self.shards)
        order = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            if self.words[s] is None:
                continue
            at, table = order[edge[s] : edge[s + 1]], self.words[s]
            found = np.minimum(np.searchsorted(table["word"], kinds[at]), len(table["word"]) - 1)
            hit = table["word"][found] == kinds[at]
            for k in _FIELDS:
                out[k][at[hit]] = table[k][found[hit]]
        return out

    def bigram_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), np.int64)
        key = _key(context, word)
        to = _shard_of(key, self.shards)
        order = np.lexsort((key, to))
        edge = np.searchsorted(to[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            if self.bigrams[s] is None:
                continue
            at, table = order[edge[s] : edge[s + 1]], self.bigrams[s]
            bucket, rest, wanted = table["bucket"], table["rest"], key[at]
            low, high = (bucket[(wanted >> np.uint64(48)).astype(np.int64) + d].astype(np.int64) for d in (0, 1))
            value = (wanted >> np.uint64(16)).astype(np.uint32)
            ends = high.copy()
            while (open_ := low < ends).any():  # binary search inside each bucket, all at once
                middle = (low + ends) >> 1
                less = open_ & (rest[np.minimum(middle, len(rest) - 1)] < value)
                low = np.where(less, middle + 1, low)
                ends = np.where(open_ & ~less, middle, ends)
            place = np.minimum(low, len(rest) - 1)
            hit = (low < high) & (rest[place] == value)
            n = np.where(hit, table["small"][place], 0).astype(np.int64)
            full = np.flatnonzero(n == 255)
            if len(full):
                n[full] = table["big"][np.searchsorted(table["big_at"], place[full])]
            if len(table["alike"]):
                twin = np.minimum(np.searchsorted(table["alike"], wanted), len(table["alike"]) - 1)
                own = table["alike"][twin] == wanted
                n[own] = table["alike_n"][twin[own]]
            out[at] = n
        return out

    def score(self, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, score."""
        token, context = _with_ends(values, counts)
        kinds, which = np.unique(np.append(token, BEGIN), return_inverse=True)
        stats = self.word_stats(kinds)
        w = which[:-1]
        first = np.cumsum(counts + 1) - (counts + 1)
        c = np.empty_like(w)
        c[1:] = w[:-1]
        c[first] = which[-1]
        pair, back = np.unique(c.astype(np.int64) << 32 | w, return_inverse=True)
        pc, pw = pair >> 32, pair & 0xFFFFFFFF
        n = self.bigram_counts(kinds[pc], kinds[pw])
        base = np.log10((stats["tokens"] + 1) / (self.total + self.types + 1))
        before = stats["before"]
        low = np.maximum(before - self.low[np.minimum(before, 3)], 0) / max(self.all_before, 1) + self.low_left / (self.types + 1)
        one, two, more = stats["one"], stats["two"], stats["more"]
        seen = np.where(kinds == BEGIN, self._begins(), stats["tokens"])
        rest = self.high[1] * one + self.high[2] * two + self.high[3] * more
        followed = (one + two + more > 0) & (seen > 0)
        left = np.where(followed, rest / np.maximum(seen, 1), 1.0)
        p = np.where(followed[pc], np.maximum(n - self.high[np.minimum(n, 3)], 0) / np.maximum(seen[pc], 1), 0.0) + left[pc] * low[pw]
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        return counts + 1, add((stats["tokens"] > 0)[w].astype(np.int64)), add(base[w]), add(np.log10(p)[back])

    def _begins(self) -> int:
        """Texts in training: as many as ends."""
        return int(self.word_stats(np.array([END], np.uint64))["tokens"][0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", flag: Column | None = None) -> DataFrame:
    """Rows ``doc_id, flag, n_tokens, n_known, base_score, score``: log10 probabilities of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for piece in slices(batch, "text", 6 << 20):
                v, c = words(piece.column("text"))
                n, known, base, full = scorer.score(v, c)
                cols = [piece.column(0), piece.column(2), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(full)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "flag", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(False) if flag is None else flag).alias("flag"))
    return rows.mapInArrow(run, "doc_id long, flag boolean, n_tokens long, n_known long, base_score double, score double")
