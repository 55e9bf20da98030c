"""The pipeline, stage by stage, against brute force on each stage's own input."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyloom.llm import bpe, mixing, queries
from tallyloom.llm.shared import WorkArea

from test_operators import components

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows, the documents first."""
    area = WorkArea(spark, "pipeline-test")
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(area.table(stage(spark, out[-1], SMALL), name))
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_quality(stages):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    kept = con.execute(f"select doc_id from ({queries.ORACLES['op9_quality']}) where kept").fetchall()
    assert ids(stages[1]) == Counter(k for (k,) in kept)


def test_exact_dedup(stages):
    best = {}
    for r in stages[1].collect():
        best[r.text or ""] = max(r.doc_id, best.get(r.text or "", r.doc_id))
    assert ids(stages[2]) == Counter(best.values())


def test_near_dedup(stages):
    rows = stages[2].select("doc_id", "text").collect()
    kept = Counter(k for k, _, label in components(rows).elements() if k == label)
    assert ids(stages[3]) == kept and len(kept) < len(rows)


def test_mixing(spark, stages):
    """Rates by a plain projected gradient over single documents; counts within one of the rate."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").selectExpr("doc_id", f"{queries.DOMAIN} as domain")
    got = mixing.document_rates(stages[3], labels, queries.TARGETS).collect()
    p, tokens = np.array([r.p for r in got]), np.array([r.tokens for r in got], float)
    assert [r.tokens for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t.text or "")) for t in sorted(stages[3].collect(), key=lambda t: [r.id for r in got].index(t.doc_id))]
    now = tokens @ p
    wanted = now * np.array([queries.TARGETS[k] for k in sorted(queries.TARGETS)])
    rate = np.ones(len(got))
    for _ in range(4000):
        gap = ((tokens * rate) @ p - wanted) / now
        rate = np.maximum(0, rate - 0.5 * (p @ gap + 1e-3 * (rate - 1)))
    best = np.abs((tokens * rate) @ p - wanted) / now
    mine = np.abs((tokens * np.array([r.rate for r in got])) @ p - wanted) / now
    assert min(r.rate for r in got) >= 0
    assert (mine <= best + 0.02).all()
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got)
    assert ids(stages[4]) == Counter({r.id: r.copies for r in got if r.copies})


def test_bpe(stages):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    assert ids(stages[5]) == ids(stages[4])
    for r in stages[5].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")


def test_run_is_the_stages(spark, stages):
    assert ids(corpus_pipeline.run(spark, SMALL)) == ids(stages[5])
