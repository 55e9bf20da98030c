"""Registered queries against brute force on the smallest tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyloom.llm import bpe, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def test_bpe(spark, texts):
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op1_bpe(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        ids = np.array(enc.encode_ordinary(text), "<u4")
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_language_model(spark, texts):
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)), None]

    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    count = Counter(w for k, text in texts.items() if not held[k] for w in tokens(text))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in queries.op3_ngram_lm(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        own = tokens(text)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(own), sum(count[w] > 0 for w in own), n)
        assert np.isclose(r.base_score, sum(np.log10((count[w] + 1) / (n + v + 1)) for w in own))
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_warc(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()
    first = {}
    for r in pages:
        first[r.html or ""] = min(r.page_id, first.get(r.html or "", r.page_id))
    got = {r.page_id: r for r in queries.op4_warc(spark, SMALL).collect()}
    assert set(got) == {r.page_id for r in pages}
    for r in pages:
        payload, own = (r.html or "").encode(), first[r.html or ""]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want = (len(payload), digest, "response" if own == r.page_id else "revisit", None if own == r.page_id else own)
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest, got[r.page_id].record_type, got[r.page_id].refers_to) == want


def test_sharding(spark, texts):
    rows = queries.op10_sharding(spark, SMALL).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts.items()}
    by = Counter(r.shard for r in rows)
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 1
    assert Counter((r.shard, r.slot) for r in rows) == Counter((s, k) for s, n in by.items() for k in range(n))
