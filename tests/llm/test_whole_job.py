"""Queries and operators do the whole job on what they are given."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing, queries, sharding, warc
from tallyloom.llm.shared import WorkArea

SMALL = "/root/testdata/sf0.001"


def test_sharding_digests_are_of_exchanged_texts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = queries.op10_sharding(spark, SMALL).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(k, len(t) + 1, zlib.crc32(t)) for k, t in texts.items()} and len(got) == docs.count()
    whole = sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df, n: whole(df.withColumn("text", F.lit("lost")), n))
    assert {(r.size, r.text_crc32) for r in queries.op10_sharding(spark, SMALL).collect()} == {(5, zlib.crc32(b"lost"))}


def test_labels_of_absent_documents_use_up_no_sample(spark):
    docs = spark.createDataFrame([(k, "vile words" if k % 2 else "good words") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3000)], "doc_id long, domain int")
    got = mixing.document_rates(docs, labels, {0: 1.0, 1: 1.0}, fit_rows=20).collect()
    assert all((r.p[1] > 0.5) == (r.id % 2 == 1) for r in got)
    none = spark.createDataFrame([(-1, 1)], "doc_id long, domain int")
    assert {tuple(r.p) for r in mixing.document_rates(docs, none, {0: 1.0, 1: 1.0}).collect()} == {(0.5, 0.5)}


def test_mixing_goes_on_to_the_optimum(spark):
    """Posteriors that overlap: many rates are zero, and 40 gradient steps fall short of the optimum."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([1.5, 3.0, 0.08], 3000)
    tokens = rng.integers(20, 400, 3000)
    soft = spark.createDataFrame([(k, k, int(n), x.tolist()) for k, (n, x) in enumerate(zip(tokens, p, strict=True))], "id long, key long, tokens long, p array<double>")
    rated, *found = mixing.fit_rates(soft, [0.5, 1.05, 0.1], WorkArea(spark, "fit"))
    got = {r.id: r.rate for r in rated.collect()}
    rate = np.array([got[k] for k in range(3000)])
    now = tokens @ p
    gap = ((tokens * rate) @ p - now * [0.5, 1.05, 0.1]) / now
    slope = p @ gap + 1e-3 * (rate - 1)  # zero where the rate is above zero, else not negative
    assert np.abs(np.where(rate > 0, slope, np.minimum(slope, 0))).max() < 2e-3
    (fit,) = found
    assert fit.converged and np.allclose(np.array(fit.reached) * tokens.sum(), (tokens * rate) @ p, rtol=1e-6)


@pytest.mark.parametrize("wanted", [[0.0, 1.0, 1.0], [2.0, 0.5, 1.0], [1.0, 1.0, 5.0]])
def test_mixing_equals_a_long_plain_descent(spark, wanted):
    """One domain has no tokens at all: its target moves nothing."""
    rng = np.random.default_rng(5)
    p = np.column_stack([rng.dirichlet([0.4, 0.8], 500), np.zeros(500)])
    tokens = rng.integers(0, 300, 500)
    soft = spark.createDataFrame([(k, k, int(n), x.tolist()) for k, (n, x) in enumerate(zip(tokens, p, strict=True))], "id long, key long, tokens long, p array<double>")
    rated, fit = mixing.fit_rates(soft, wanted, WorkArea(spark, "descent"))
    got = {r.id: r.rate for r in rated.collect()}
    w, rate = tokens / tokens.sum(), np.ones(500)
    base = np.maximum(w @ p, 1e-9)
    for _ in range(60000):
        rate = np.maximum(0, rate - 0.9 * (p @ (((w * rate) @ p - (w @ p) * wanted) / base) + 1e-3 * (rate - 1)))
    assert fit.converged and fit.scans < 200
    assert (np.abs(np.array(fit.reached) - (w * rate) @ p) / base).max() < 2e-3  # of the domain's tokens, as the search weighs them
    assert np.sqrt(w @ (np.array([got[k] for k in range(500)]) - rate) ** 2) < 0.05


def test_warc_revisits_of_a_page_with_two_payloads(spark):
    rows = [(1, "u", "one"), (1, "u", "another"), (2, "u", "one"), (3, "u", "another")]
    area = WorkArea(spark, "warc-two")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), area.path("a"), area)
    got = warc.read_archive(spark, area.path("a"), area).collect()
    assert sorted((r.page_id, bytes(r.payload).decode(), r.refers_to, r.ok) for r in got if r.refers_to) == [(2, "one", 1, True), (3, "another", 1, True)]
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == sorted(rows)
