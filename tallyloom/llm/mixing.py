"""Mixing to target weights with soft domain membership.

Method. (1) A labelled table names the domain of some documents; a softmax classifier over hashed word counts,
fitted on at most ``fit_rows`` labelled documents (the smallest hashes of the id: the only sample here), gives every document
posterior probabilities of the domains. (2) Every document has a rate, at first one. Its expected domain tokens are rate x
tokens x posterior. Rates of zero or more minimize the squared distance of the corpus's expected domain totals from the
targets, each relative to the domain's tokens now (so that a rare domain weighs as much as a common one), with a small
pull of each rate towards one. The search is a projected gradient: each step moves all rates down the gradient, by a length from the last
step's change of the gradient, and raises negative ones to zero; a step after which the squared distance is over a hundredth above all of the last few is taken again
with the length that always lowers it. It ends when a step moves rates by less than a tolerance. A rate's gradient follows from its document's posterior and
the domains' gaps, so that a rate is a function of the posterior and the steps taken, which are as many numbers as domains each. A document's posterior
enters rounded to 1/``GRID``; so documents are first summed by that rounded posterior into cells, which keep the exact tokens of each
domain. Cells are bounded by the grid, not by the corpus (half a million for three domains). Each step is one scan of the cells, and
nothing but sums over them reaches the driver. The totals reached and whether the search ended are in :class:`Fit`. (3) The whole part of a rate is a number of
copies; the rest is decided by a hash of the id, the same on every run.

Domains are columns, so they must be few; documents may be any number, and no step groups or sorts them.

Defined results. Null text has no tokens: its posterior is the classifier's bias and its rate moves no total. Null ids are
hashed as such. Repeated rows count each. Labels of absent documents are ignored, and a document labelled twice uses
the row of the smallest domain. Of rows with one labelled id the classifier reads one. Without labels all posteriors are equal. Extra columns are carried by :func:`mix`.
"""

from __future__ import annotations

import math
import pickle
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WorkArea, fresh_name, mark_known
from .wordhash import slices, words

FEATURES = 1 << 12
#: Rates are functions of posteriors rounded to 1 / GRID.
GRID = 1000


def _bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight) of hashed words, unit length for each text, and the words of each text."""
    values, counts = words(column)
    owner = np.repeat(np.arange(len(counts)), counts)
    key, n = np.unique(owner * FEATURES + (values % np.uint64(FEATURES)).astype(np.int64), return_counts=True)
    text, feature = key // FEATURES, key % FEATURES
    w = np.log1p(n)
    norm = np.sqrt(np.bincount(text, w * w, minlength=len(counts)))
    return text, feature, w / norm[text], counts


def _scores(bag, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    text, feature, w, counts = bag
    return np.stack([np.bincount(text, w * weights[feature, k], minlength=len(counts)) for k in range(len(bias))], axis=1) + bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Classifier:
    domains: tuple[int, ...]
    weights: np.ndarray
    bias: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, domains: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 6000, steps: int = 300) -> Classifier:
    """``labels``: (id_col, domain). One task fits the bounded sample; its result is FEATURES x domains numbers."""
    own = labels.where(F.col("domain").isin(*domains)).groupBy(F.col(id_col).alias("label_id")).agg(F.min("domain").alias("domain"))
    own = own.join(docs.select(F.col(id_col).alias("label_id")).distinct(), "label_id", "left_semi")  # absent documents use up no row of the sample
    chosen = own.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "label_id").select(F.xxhash64("label_id").alias("label_id"), "text", "domain")
    rows = rows.mapInArrow(_shrink, "label_id long, text string, domain int")
    rows = rows.groupBy("label_id").agg(F.min("text").alias("text"), F.first("domain").alias("domain"))  # at most fit_rows rows

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, features, ws, ys, n = [], [], [], [], 0
        for batch in batches:
            t, f, w, counts = _bags_of_pairs(batch.column(1).to_pylist())
            texts.append(t + n)
            features.append(f)
            ws.append(w)
            ys.append(batch.column(2).to_numpy())
            n += len(counts)
        weights, bias = np.zeros((FEATURES, len(domains))), np.zeros(len(domains))
        if n:
            t, f, w = np.concatenate(texts), np.concatenate(features), np.concatenate(ws)
            goal = (np.concatenate(ys)[:, None] == np.array(domains)[None]).astype(float)
            m1, m2 = np.zeros_like(weights), np.zeros_like(weights)
            for step in range(1, steps + 1):
                gap = _softmax(_scores((t, f, w, np.empty(n)), weights, bias)) - goal
                grad = np.stack([np.bincount(f, w * gap[t, k], minlength=FEATURES) for k in range(len(domains))], axis=1) / n + 1e-6 * weights
                m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
                weights -= 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
                bias -= 2.0 * gap.mean(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((weights.astype(np.float32), bias))], pa.binary())], names=["model"])

    # One task by intent: at most fit_rows bags of hashed words, whatever the size of the corpus. The exchange before keeps the scan parallel.
    trained = rows.repartition(1).sortWithinPartitions("label_id").mapInArrow(train, "model binary").first()
    weights, bias = pickle.loads(trained[0]) if trained else (np.zeros((FEATURES, len(domains)), np.float32), np.zeros(len(domains)))
    return Classifier(domains, weights, bias)


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their hashed words and counts, so that the fitting task reads little."""
    for batch in batches:
        for piece in slices(batch, "text"):
            text, feature, w, counts = _bags(piece.column(1))
            edge = np.searchsorted(text, np.arange(len(counts) + 1))
            out = [" ".join(f"{a}:{b:.5g}" for a, b in zip(feature[x:y].tolist(), w[x:y].tolist(), strict=True)) for x, y in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, pa.string()), piece.column(2).cast(pa.int32())], names=["label_id", "text", "domain"])


def _bags_of_pairs(bags: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts = np.array([b.count(":") for b in bags], dtype=np.int64)
    flat = " ".join(b for b in bags if b).replace(":", " ").split()
    pairs = np.array(flat, dtype=float).reshape(-1, 2)
    return np.repeat(np.arange(len(bags)), counts), pairs[:, 0].astype(np.int64), pairs[:, 1], counts


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, u, tokens, p): ``p`` the domains' probabilities, ``u`` a uniform number from the id and the text."""
    weights, bias = model.weights.astype(np.float64), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                bag = _bags(piece.column("text"))
                p = _softmax(_scores(bag, weights, bias))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(bag[3]), pa.array(list(p), pa.list_(pa.float64()))], names=["id", "key", "tokens", "p"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), mix_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, key long, tokens long, p array<double>")


def mix_key(id_col: str, text_col: str):
    return F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col))


def _cell():
    """The grid point of a posterior."""
    return F.transform("p", lambda x: F.floor(x * GRID + 0.5).cast("int"))


def cells(soft: DataFrame, domains: int) -> DataFrame:
    """(cell, t, e0, e1, ...): tokens of the documents at each grid point, and their expected tokens of each domain."""
    return soft.groupBy(_cell().alias("cell")).agg(F.sum("tokens").alias("t"), *(F.sum(F.col("tokens") * F.get("p", F.lit(k))).alias(f"e{k}") for k in range(domains)))


@dataclass(frozen=True)
class Fit:
    """Expected shares of the domains in all tokens: ``before``, ``targets`` and ``reached``; ``converged``: the last step moved rates by less than the tolerance."""

    before: tuple[float, ...]
    targets: tuple[float, ...]
    reached: tuple[float, ...]
    converged: bool
    scans: int


@dataclass(frozen=True)
class Step:
    """One step of the search: its length, and each domain's distance from its target before it, relative to the domain's tokens."""

    length: float
    gaps: tuple[float, ...]


def _walk(own: np.ndarray, steps: list[Step], pull: float, rate: np.ndarray | None = None) -> np.ndarray:
    """Rates of the posteriors ``own`` after the steps, from ``rate`` or one."""
    rate = np.ones(len(own)) if rate is None else rate
    for step in steps:
        rate = np.maximum(0.0, rate - step.length * (own @ np.array(step.gaps) + pull * (rate - 1.0)))
    return rate


def _with_rates(soft: DataFrame, domains: int, steps: list[Step], pull: float) -> DataFrame:
    """``soft`` with ``rate``: :func:`_walk` of each row's cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p")
            own = np.trunc(p.flatten().to_numpy(zero_copy_only=False) * GRID + 0.5).reshape(len(p), domains) / GRID
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_walk(own, steps, pull))], names=[*batch.schema.names, "rate"])

    return soft.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in soft.schema) + ", rate double")


def fit_rates(soft: DataFrame, wanted: list[float], area: WorkArea, pull: float = 1e-3, most_scans: int = 400, tolerance: float = 1e-4, memory: int = 8) -> tuple[DataFrame, Fit]:
    """``soft`` with ``rate``, and the :class:`Fit`; ``wanted``: each domain's tokens as a multiple of its expected tokens; ``tolerance``: how far the last step moves rates, in the mean over tokens."""
    n = len(wanted)
    grid = area.table(cells(soft, n), "cells")
    sums = ["n", "far", "moved", *(f"e{k}" for k in range(n))]

    def scan(steps: list[Step]) -> tuple[float, np.ndarray, float, float]:
        """Tokens, expected tokens by domain, and the squared distances of rates from one and from those before the last step, times tokens."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("cell").flatten().to_numpy().reshape(len(batch), n) / GRID
                t, e = batch.column("t").to_numpy(), [batch.column(f"e{k}").to_numpy() for k in range(n)]
                last = _walk(own, steps[:-1], pull)
                rate = _walk(own, steps[-1:], pull, last)
                found = [t.sum(), t @ (rate - 1.0) ** 2, t @ (rate - last) ** 2, *(x @ rate for x in e)]
                yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in found], names=sums)

        row = grid.mapInArrow(run, ", ".join(f"{x} double" for x in sums)).agg(*(F.sum(x).alias(x) for x in sums)).first()
        total, far, moved, *e = (float(row[x] or 0) for x in sums)
        return total or 1.0, np.array(e), far, moved

    total, now, _, _ = scan([])
    before = now / total
    targets = np.array(wanted) * before
    base = np.where(before > 0, before, 1.0)
    height = lambda e, far: float(((e / total - targets) ** 2 / base).sum() + pull * far / total)
    safe = 1.0 / (1.0 + pull)  # the gradient changes at most 1 + pull times as fast as the rates
    steps: list[Step] = []
    length, heights, scans, converged = safe, [height(now, 0.0)], 1, False
    while not converged and scans < most_scans:
        step = Step(length, tuple(((now / total - targets) / base).tolist()))
        _, e, far, moved = scan([*steps, step])
        scans += 1
        if length > safe and height(e, far) > 1.01 * max(heights[-memory:]):
            length = safe
            continue
        converged = math.sqrt(moved / total) <= tolerance * min(length, 1.0)
        bend = (((e - now) / total) ** 2 / base).sum() + pull * moved / total
        length = min(max(moved / total / bend, safe), 1.0 / pull) if bend > 0 else safe
        steps.append(step)
        heights.append(height(e, far))
        now = e
    return _with_rates(soft, n, steps, pull), Fit(tuple(before.tolist()), tuple(targets.tolist()), tuple((now / total).tolist()), converged, scans)


def copies(rate, key):
    """How many times a row appears: the whole part, and one more with the fraction's probability."""
    u = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def _rated(docs: DataFrame, labels: DataFrame, targets: dict[int, float], id_col: str, text_col: str, fit_rows: int, area: WorkArea, on_fit: Callable[[Fit], None] | None) -> DataFrame:
    domains = tuple(sorted(targets))
    model = fit(docs, labels, domains, id_col, text_col, fit_rows)
    soft = area.table(posteriors(docs, model, id_col, text_col), "posteriors")
    rated, found = fit_rates(soft, [targets[d] for d in domains], area)
    if on_fit:
        on_fit(found)
    elif not found.converged:
        warnings.warn(f"rates did not converge: {found}", stacklevel=3)
    return rated.withColumn("copies", copies(F.col("rate"), F.col("key")))


def document_rates(
    docs: DataFrame, labels: DataFrame, targets: dict[int, float], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 6000, area: WorkArea | None = None, on_fit: Callable[[Fit], None] | None = None
) -> DataFrame:
    """(id, key, tokens, p, rate, copies) of each row. ``targets``: a domain's tokens as a multiple of its expected tokens now.

    ``on_fit`` gets the totals reached and whether the search converged; without it, a search that did not warns.
    """
    return _rated(docs, labels, targets, id_col, text_col, fit_rows, area or WorkArea(docs.sparkSession, "mixing"), on_fit)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[int, float], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 6000, area: WorkArea | None = None, on_fit: Callable[[Fit], None] | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says; same columns.

    Only rows that may have other than one copy, by a bitmap of their keys, are exchanged.
    """
    area = area or WorkArea(docs.sparkSession, "mixing")
    names = docs.columns
    key, times, one, flag = (fresh_name(names, x) for x in ("mix_key", "times", "one", "maybe"))
    rated = _rated(docs, labels, targets, id_col, text_col, fit_rows, area, on_fit)
    changed = area.table(rated.where("copies <> 1").groupBy(F.col("key").alias(key)).agg(F.first("copies").alias(times)), "changed")
    marked = mark_known(docs.withColumn(key, mix_key(id_col, text_col)), F.col(key), changed.select(F.col(key).alias("h")), flag)
    same = marked.where(~F.col(flag)).select(*names)
    other = marked.where(flag).join(changed, key, "left").withColumn(times, F.coalesce(times, F.lit(1).cast("long"))).where(F.col(times) > 0)
    return same.unionByName(other.select(*names, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int"))).alias(one)).select(*names))
