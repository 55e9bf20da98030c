"""Near-duplicates by a chosen-path set similarity join on shingles.

Method. A text's set is its distinct five-word shingles, as 64-bit values; its sketch is 64 minwise tokens.
Texts whose whole sets have one 128-bit digest become one class first. Independent trees then branch the classes: at a
node, two of the sketch's coordinates are chosen by a hash of the path, and a class goes to the child named by its
minwise token there. Two sets of similarity s stay together at a coordinate with probability s.

Nodes whose members are all in one component are done: more comparisons could not link anything new. Members of
other nodes are compared by sketch: all pairs of a node of at most ``leaf`` members, in pairs of blocks, and all pairs of each random block of
a larger one. Pairs that agree in 34 of 64 coordinates or more, and whose sizes allow the similarity, are candidates. One of each member,
that of the best agreement, is confirmed on the full sets first, and the components found are taken up: so a group of copies is
linked by a few pairs a member. Members that still have candidates in other components meet once more with their
sets at hand: what passes there is confirmed. Confirming reads the full sets in 32 bits a shingle, and again in 64 bits where collisions
could decide. A large node is finished when the members outside its
largest component are at most ``block``: these meet every block. Otherwise it branches on; nodes still large at the last
level are compared exhaustively, in pairs of blocks.

Recall. With two children at each level a pair at 0.75 survives a tree with probability 0.889 or more at
any depth; eight trees miss it with probability under 3e-8. A pair at 0.75 fails the sketch test with
probability under 4e-5. Above 0.75 both fall fast.

Only sets in some candidate pair are rebuilt and exchanged, and texts themselves never are. No task gathers more than a block.

Defined results. Null and empty texts and texts without words have the empty set and are linked with nothing: each is its own
component, and kept. Fewer than five words are one shingle. Repeated rows are one class. A row with a null id takes
part; a component's id is its smallest non-null id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import WorkArea, fresh_name, mark_known
from .wordhash import mix, shingles, slices, words

COORDINATES = 64
TREES = 8
AGREE = 34
BEST = 1  # candidates of a member that are confirmed first
_TINY = 32  # members up to which nodes are compared by array operations over many nodes

_keys = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _distinct(values: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and how many."""
    owner = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])) if len(values) else np.zeros(0, bool)
    return values[new], np.bincount(owner[new], minlength=len(per))


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _distinct(*shingles(*words(column), size))


def _members(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    edge = np.concatenate(([0], np.cumsum(sizes)))
    return [values[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _digest(members: bytes) -> bytes:
    return blake2b(members, digest_size=16).digest()


def _sketch(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minwise tokens (texts x coordinates, 32 bits); texts with an empty set get zeros."""
    out = np.zeros((len(sizes), COORDINATES), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        low, high = values & np.uint64(0xFFFFFFFF), values >> np.uint64(32)
        for k in range(COORDINATES):
            h = (low * _keys[k] + high * _keys[-1 - k] + _keys[k]) * np.uint64(0xD6E8FEB86659FD93)
            out[full, k] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), first)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([bytes(x) for x in rows], pa.binary())


def describe(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, digest, sketch, brief) of each row; ``brief`` is a byte of each coordinate, which comparisons use."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                values, sizes = _sets(piece.column(1), size)
                sketch = _sketch(values, sizes)
                digests = pa.array(map(_digest, _members(values, sizes)), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(sizes.astype(np.int64)), digests, _binary(sketch), _binary(sketch.astype(np.uint8))], names=["id", "n_shingles", "digest", "sketch", "brief"]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_shingles long, digest binary, sketch binary, brief binary")


def with_digest(docs: DataFrame, text_col: str, size: int, name: str) -> DataFrame:
    """``docs`` with ``name``: the digest of each row's set."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                digests = pa.array(map(_digest, _members(*_sets(piece.column(at), size))), pa.binary())
                yield pa.RecordBatch.from_arrays([*piece.columns, digests], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def _full_sets(texts: DataFrame, size: int, kind: type) -> DataFrame:
    """(id, digest, members): the sorted shingles of each row of (id, text), as integers of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                whole = _members(*_sets(piece.column(1), size))
                members = whole if kind is np.uint64 else [np.unique(np.frombuffer(x, np.uint64).astype(kind)).tobytes() for x in whole]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(map(_digest, whole), pa.binary()), pa.array(members, pa.binary())], names=["id", "digest", "members"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, digest binary, members binary")


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, COORDINATES)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every class at its children of the trees' roots: two coordinates for each tree."""
    at = np.arange(2 * TREES, dtype=np.uint64)
    for batch in batches:
        names = _matrix(batch.column(1), np.uint32)[:, : len(at)].astype(np.uint64) << np.uint64(8) | at
        yield pa.RecordBatch.from_arrays([pa.array(mix(names).view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), len(at)))], names=["node", "set_id"])


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, ids = (batch.column(k).to_numpy() for k in (0, 1))
        sketch = _matrix(batch.column(2), np.uint32)
        out = []
        for k in (1, 2):
            path = mix(node.view(np.uint64) + np.uint64(k))
            at = (path % np.uint64(COORDINATES)).astype(np.int64)
            out.append(mix(path ^ mix(sketch[np.arange(len(node)), at].astype(np.uint64))).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate([ids, ids]))], names=["node", "set_id"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables that hold whole groups of it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and key[0] != held[-1].column(0)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal coordinates of each row, eight at a time."""
    return (((a == b).view(np.uint64).sum(axis=1) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


class _Groups:
    """Rows (group, set_id, label before, label, side, size, brief) of whole groups, and which rows may be near."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        self.group, self.ids, self.before, self.label, self.side, self.size = (table.column(k).to_numpy() for k in range(6))
        self.brief, self.percent = _matrix(table.column(6), np.uint8), percent
        self.first = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1]))
        self.stops = np.append(self.first[1:], len(self.group))

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs that may be linked and were not connected before."""
        small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        return (100 * small >= self.percent * large) & (self.before[i] != self.before[j]) & ((self.side[i] != self.side[j]) | (self.side[i] < 0))

    def in_tiny(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(later row, earlier row, rank by agreement) of candidates in groups of few members, all groups at once."""
        later, earlier, agreement = ([np.zeros(0, np.int64)] for _ in range(3))
        sizes, row = self.stops - self.first, np.arange(len(self.ids))
        stop = np.repeat(np.where(sizes <= _TINY, self.stops, self.first), sizes)
        for d in range(1, min(int(sizes.max(initial=0)), _TINY)):
            i = row[row + d < stop]
            if not len(i):
                break
            n = _agreement(self.brief[i + d], self.brief[i])
            good = (n >= AGREE) & self.possible(i + d, i)
            later.append(i[good] + d)
            earlier.append(i[good])
            agreement.append(n[good])
        i, j, n = map(np.concatenate, (later, earlier, agreement))
        order = np.lexsort((j, -n, i))
        i, j = i[order], j[order]
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        return i, j, np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))

    def in_large(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, earlier rows by agreement) of candidates in the other groups."""
        for a, b in zip(self.first.tolist(), self.stops.tolist(), strict=True):
            if b - a <= _TINY or (self.label[a:b] == self.label[a]).all():
                continue
            for k in range(a + 1, b):
                n = _agreement(self.brief[a:k], self.brief[k])
                near = np.flatnonzero(n >= AGREE)
                if len(near):
                    near = near[self.possible(np.full(len(near), k), near + a)]
                    yield k, near[np.argsort(-n[near], kind="stable")] + a


_FOUND = "a long, b long, group long, before long, side int"


def _best(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted groups, each member's best candidates (a, b), and rows (set_id, null, group, before, side) of members of pairs beyond those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            g = _Groups(table, percent)
            i, j, rank = g.in_tiny()
            left = np.zeros(len(g.ids), bool)
            left[i[rank >= BEST]] = left[j[rank >= BEST]] = True
            later, earlier = [i[rank < BEST]], [j[rank < BEST]]
            for k, near in g.in_large():
                later.append(np.full(len(near[:BEST]), k))
                earlier.append(near[:BEST])
                if len(near) > BEST:
                    left[near[BEST:]] = left[k] = True
            a, b = g.ids[np.concatenate(later)], g.ids[np.concatenate(earlier)]
            n, none = len(a), pa.nulls
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int32())], names=["a", "b", "group", "before", "side"])
            yield pa.RecordBatch.from_arrays([pa.array(g.ids[left]), none(int(left.sum()), pa.int64()), *(pa.array(x[left]) for x in (g.group, g.before, g.side))], names=["a", "b", "group", "before", "side"])

    return run


def _passing(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted groups whose last column is each member's set in 32 bits: pairs (a, b) that are similar by it, a few for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            g = _Groups(table, percent)
            sets = table.column(7).to_pylist()
            flat = np.frombuffer(b"".join(sets), np.uint32)
            size = np.fromiter(map(len, sets), np.int64, len(sets)) // 4
            at = np.cumsum(size) - size
            own = np.repeat(np.arange(len(g.first)), g.stops - g.first)
            label, a, b = g.label.copy(), [], []

            def test(k: int, near: np.ndarray) -> None:
                for chunk in np.split(near, [x for x in (16, 64, 256, 1024) if x < len(near)]):
                    chunk = chunk[label[chunk] != label[k]]
                    if not len(chunk):
                        continue
                    n = size[chunk]
                    begin = np.cumsum(n) - n
                    value = flat[np.arange(int(n.sum())) + np.repeat(at[chunk] - begin, n)]
                    mine = flat[at[k] : at[k] + size[k]]
                    both = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, value), len(mine) - 1)] == value, begin)
                    union = g.size[k] + g.size[chunk] - both
                    almost = chunk[100 * (both + 1) >= percent * (union - 1)]  # 32 bits may be off by one
                    sure = chunk[100 * both >= percent * union]
                    one = almost[np.unique(label[almost], return_index=True)[1]] if len(sure) == len(almost) else almost
                    a.extend([int(g.ids[k])] * len(one))
                    b.extend(g.ids[one].tolist())
                    if len(sure):
                        here = slice(int(g.first[own[k]]), int(g.stops[own[k]]))
                        label[here][np.isin(label[here], label[sure])] = label[k]

            i, j, rank = g.in_tiny()
            start = np.flatnonzero(rank == 0).tolist()
            for x, y in zip(start, [*start, len(i)][1:], strict=True):
                test(int(i[x]), j[x:y])
            for k, near in g.in_large():
                test(k, near)
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _confirm(percent: int, kind: type):
    """Of (a, b, their sizes, their sets): (a, b, sure), the links; in 32 bits also pairs that a few collisions could make links, not sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sure = [], [], []
            for x, y, m, n, u, v in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                p, q = np.frombuffer(u, kind), np.frombuffer(v, kind)
                small, large = (p, q) if len(p) < len(q) else (q, p)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                slack = 0 if kind is np.uint64 else 2 + (m * n >> 26) + (m + n - len(p) - len(q))
                if 100 * (both + slack) >= percent * (m + n - both - slack):
                    a.append(x)
                    b.append(y)
                    sure.append(100 * (both - slack) >= percent * (m + n - both + slack))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])

    return run


class _Join:
    """The state of one run."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, area: WorkArea) -> None:
        self.docs, self.id_col, self.text_col, self.size, self.percent, self.area = docs, id_col, text_col, size, percent, area
        self.rows = area.table(describe(docs, id_col, text_col, size), "rows")
        whole = self.rows.where("n_shingles > 0").groupBy("digest")
        classes = whole.agg(F.min("id").alias("id"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief"))
        self.classes = area.table(classes.withColumn("set_id", F.monotonically_increasing_id()), "classes")  # written: the numbers stay
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.round = self.fetched = 0
        self.repeated = not self.rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()  # then a class has several rows of one id

    def labelled(self, members: DataFrame, name: str = "label") -> DataFrame:
        if self.labels is None:
            return members.withColumn(name, F.col("set_id"))
        return members.join(self.labels.select(F.col("node").alias("set_id"), F.col("label").alias("_label")), "set_id", "left").withColumn(name, F.coalesce("_label", "set_id")).drop("_label")

    def confirm(self, candidates: DataFrame) -> None:
        """Add the candidates that hold on the full sets to the links, and take up the components."""
        area, k = self.area, self.round
        if self.tested is not None:
            candidates = candidates.join(self.tested, ["a", "b"], "left_anti")
        candidates = area.table(candidates, f"candidates-{k}")
        self.tested = candidates if self.tested is None else self.tested.unionByName(candidates)
        if candidates.isEmpty():
            return
        tried = area.table(self.similar(candidates, np.uint32), f"tried-{k}")
        links = tried.where("sure").select("a", "b")
        close = tried.where(~F.col("sure")).select("a", "b")
        if not close.isEmpty():
            links = links.unionByName(area.table(self.similar(close, np.uint64).select("a", "b"), f"close-{k}"))
        if not links.isEmpty():
            self.links = links if self.links is None else self.links.unionByName(links)
            self.labels = components(self.links, area, f"cc-{k}")

    def similar(self, pairs: DataFrame, kind: type) -> DataFrame:
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("set_id")), kind)
        met = pairs.join(sets.toDF("a", "m", "u"), "a").join(sets.toDF("b", "n", "v"), "b").select("a", "b", "m", "n", "u", "v")
        return met.mapInArrow(_confirm(self.percent, kind), "a long, b long, sure boolean")

    def sets(self, ids: DataFrame, kind: type) -> DataFrame:
        """(set_id, size, members) of the wanted classes, from one row of each."""
        self.fetched += 1
        area, name = self.area, f"sets-{self.fetched}"
        known = area.table(self.classes.join(ids.distinct(), "set_id").select("id", "set_id", "size", "digest"), f"known-{self.fetched}")
        # Rows that may hold a wanted set; a null id is looked for among null ids.
        texts = self.docs.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text"))
        some = mark_known(texts, F.xxhash64("id"), known.select(F.xxhash64("id").alias("h")), flag="near_known").where("near_known")
        some = _full_sets(some.select("id", "text"), self.size, kind).withColumnsRenamed({"id": "id2", "digest": "digest2"})
        sets = some.join(known, (F.col("digest") == F.col("digest2")) & F.col("id").eqNullSafe(F.col("id2"))).select("set_id", "size", "members")
        if self.repeated:
            sets = sets.groupBy("set_id").agg(F.first("size").alias("size"), F.first("members").alias("members"))
        return area.table(sets, name)

    def grouped(self, groups: DataFrame, *more: str) -> DataFrame:
        columns = ["group", "set_id", "before", "label", "side", "size", "brief", *more]
        return self.labelled(groups).join(self.classes.select("set_id", "size", "brief"), "set_id").select(*columns).repartition("group").sortWithinPartitions("group", "set_id")

    def compare(self, groups: DataFrame) -> None:
        """Link what is near in ``groups`` (group, set_id, before, side), each of bounded size."""
        self.round += 1
        k, area = self.round, self.area
        found = area.table(self.grouped(groups).mapInArrow(_best(self.percent), _FOUND), f"found-{k}")
        pairs, left = found.agg(F.count("b"), F.count_if(F.col("b").isNull())).first()
        if pairs:
            self.confirm(found.where("b is not null").select("a", "b").distinct())
        if not left:
            return
        self.round += 1
        rest = area.table(self.labelled(found.where("b is null").select("group", F.col("a").alias("set_id"), "before", "side")), f"rest-{k}")
        apart = rest.groupBy("group").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("group")
        rest = area.table(rest.drop("label").join(apart, "group"), f"apart-{k}")
        if rest.isEmpty():
            return
        sets = self.sets(rest.select("set_id"), np.uint32).select("set_id", "members")
        passing = self.grouped(rest.join(sets, "set_id"), "members").mapInArrow(_passing(self.percent), "a long, b long")
        self.confirm(passing.distinct())
        area.drop(f"rest-{k}", f"apart-{k}", f"found-{k}")

    def open_members(self, placed: DataFrame, name: str) -> DataFrame:
        """(node, set_id, before, n): members of nodes that hold more than one component, with the node's size."""
        per = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("l1"), F.max("before").alias("l2"))
        per = self.area.table(per.where("l1 <> l2").select("node", "n"), f"nodes-{name}")
        own = mark_known(placed, F.xxhash64("node"), per.select(F.xxhash64("node").alias("h"))).where("maybe").drop("maybe")
        return self.area.table(own.join(per, "node"), f"open-{name}")


def _group(*parts: Column | str) -> Column:
    return F.xxhash64("node", *parts).alias("group")


def _random_blocks(members: DataFrame, block: int) -> DataFrame:
    at = F.pmod(F.xxhash64("node", "set_id"), F.ceil(F.col("n") / block))
    return members.select(_group(at), "set_id", "before", F.lit(-1).alias("side"))


def _pairs_of_blocks(members: DataFrame, block: int) -> DataFrame:
    """All pairs of each node: members in blocks of about ``block``, each pair of blocks one bounded group."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    met = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"x": F.least("i", "j"), "y": F.greatest("i", "j")})
    return met.select(_group("x", "y"), "set_id", "before", F.when(F.col("x") == F.col("y"), -1).otherwise(F.col("i")).alias("side"))


def link_sets(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, leaf: int, depth: int, block: int, area: WorkArea) -> _Join:
    run = _Join(docs, id_col, text_col, size, percent, area)
    sketches = run.classes.select("set_id", "sketch")
    placed = sketches.mapInArrow(_roots, "node long, set_id long").withColumn("before", F.col("set_id"))
    for level in range(depth):
        opened = run.open_members(placed, f"{level}")
        large = opened.where(F.col("n") > leaf)
        if level == depth - 1:
            run.compare(_pairs_of_blocks(opened, block))
            break
        run.compare(_pairs_of_blocks(opened.where(F.col("n") <= leaf), block).unionByName(_random_blocks(large, block)))
        if large.isEmpty():
            break
        # Few members outside a large node's largest component: they meet every block, and the node is finished.
        large = area.table(run.labelled(large.select("node", "set_id"), "before"), f"large-{level}")
        per = large.groupBy("node", "before").agg(F.count(F.lit(1)).alias("m")).groupBy("node")
        per = per.agg(F.sum("m").alias("n"), F.max_by("before", "m").alias("top"), (F.sum("m") - F.max("m")).alias("others"))
        large = large.join(area.table(per.where("others > 0"), f"tops-{level}"), "node")
        blocks = F.ceil(F.col("n") / block).cast("int")
        met = F.when(F.col("before") == F.col("top"), F.array(F.pmod(F.xxhash64("set_id"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
        few = large.where(F.col("others") <= block).select("node", "set_id", "before", F.explode(met).alias("block"))
        run.compare(few.select(_group("block"), "set_id", "before", F.lit(-1).alias("side")))
        many = large.where(F.col("others") > block).select("node", "set_id").join(sketches, "set_id").select("node", "set_id", "sketch")
        placed = run.labelled(many.mapInArrow(_children, "node long, set_id long").distinct(), "before")
    return run


def _named(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, leaf: int, depth: int, block: int, area: WorkArea) -> DataFrame:
    """(id, digest, n_shingles, component_id) of each row."""
    run = link_sets(docs, id_col, text_col, size, percent, leaf, depth, block, area)
    own = run.labelled(run.classes.select("set_id", "id", "digest"))
    named = own.select("digest", "label").join(own.groupBy("label").agg(F.min("id").alias("component_id")), "label").select("digest", "component_id")
    named = area.table(named, "named")
    rows = run.rows.select("id", "n_shingles", "digest")
    full = rows.where("n_shingles > 0").join(named, "digest").select("id", "digest", "n_shingles", "component_id")
    return full.unionByName(rows.where("n_shingles = 0").select("id", "digest", "n_shingles", F.col("id").alias("component_id")))


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, leaf: int = 4096, depth: int = 8, block: int = 2048, area: WorkArea | None = None
) -> DataFrame:
    """One row for each input row: ``doc_id, n_shingles, component_id, kept``.

    ``size``: words in a shingle; ``percent``: least similarity; ``leaf``: members of a node compared exhaustively;
    ``depth``: levels of a tree; ``block``: members of a block, of which a task compares two.
    """
    area = area or WorkArea(docs.sparkSession, "near-dedup")
    rows = _named(docs, id_col, text_col, size, percent, leaf, depth, block, area)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, leaf: int = 4096, depth: int = 8, block: int = 2048, area: WorkArea | None = None
) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; same columns.

    A row goes by its id and its set, so that of rows with one id and different texts only the near copies go. Rows that the
    filter of dropped ids does not know stay where they are; only the others are exchanged.
    """
    area = area or WorkArea(docs.sparkSession, "near-dedup")
    names = docs.columns
    flag, key, mine, other = (fresh_name(names, x) for x in ("known", "gone_id", "set_digest", "gone_digest"))
    gone = _named(docs, id_col, text_col, size, percent, leaf, depth, block, area).where("not (id <=> component_id)")
    gone = area.table(gone.select(F.col("id").alias(key), F.col("digest").alias(other)).distinct(), "gone")
    marked = mark_known(docs, F.xxhash64(F.col(id_col)), gone.select(F.xxhash64(key).alias("h")), flag=flag)
    sure = marked.where(~F.col(flag)).drop(flag)
    rest = with_digest(marked.where(flag).drop(flag), text_col, size, mine)
    return sure.unionByName(rest.join(gone, (F.col(mine) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(key)), "left_anti").drop(mine))
