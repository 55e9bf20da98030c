"""Each operator against a brute-force version, on rows with nulls, empty, long and repeated texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat, exact_dedup, line_runs, mixing, near_dedup, ngram_lm, quality, queries, sharding, warc
from tallyloom.llm.shared import WorkArea

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, maybe string, label int"


def texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(40)]
    out = [None, "", "   ", "One", "two words", "a\nb\na\nb\na\nb", "x" * 70_000, "Ab " * 5000, "é'll 中文 ½ z"]
    for b in base:
        w = b.split()
        out.append(b)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return [*out, *base[:6], None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 11 else None, t, "m", k) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[9], rows[9]], SCHEMA).repartition(3).persist()


def words(t, lower=True):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_bpe_equals_tiktoken(docs):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.encode(docs, RANKS).collect()
    assert len(got) == docs.count()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bpe.round_trip(docs.limit(0), RANKS).isEmpty()


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1))])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, digest, keep):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    pick = lambda ids: (min if keep == "smallest" else max)((i for i in ids if i is not None), default=None)
    got = exact_dedup.exact_dedup(docs, keep=keep, digest=digest).collect()
    want = Counter((r.doc_id, pick(groups[r.text or ""]), len(groups[r.text or ""])) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    left = exact_dedup.drop_copies(docs, keep=keep, digest=digest)
    assert left.columns == docs.columns
    assert sorted((r.text or "", str(r.doc_id)) for r in left.collect()) == sorted((t, str(pick(i))) for t, i in groups.items())
    assert exact_dedup.exact_dedup(docs.limit(0)).isEmpty()


BEGIN = object()


def kneser_ney(sequences):
    """The interpolated modified bigram model by dictionaries: (probability of a word after a context, contexts)."""
    pairs = Counter(x for t in sequences for x in zip([BEGIN, *t], t))
    before = Counter(w for _, w in pairs)
    total, after = Counter(), {}
    for (h, w), n in pairs.items():
        total[h] += n
        after.setdefault(h, []).append(n)

    def discount(counts):
        n = [sum(c == k for c in counts) for k in range(5)]
        if not all(n[1:]):
            return lambda c: 0.5 if c else 0.0
        y = n[1] / (n[1] + 2 * n[2])
        d = [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))]
        return lambda c: d[min(c, 3)]

    high, low = discount(list(pairs.values())), discount(list(before.values()))
    spare = sum(map(low, before.values())) / len(pairs)

    def p(h, w):
        lower = max(before[w] - low(before[w]), 0) / len(pairs) + spare / (len(before) + 1)
        if h not in after:
            return lower
        return max(pairs[h, w] - high(pairs[h, w]), 0) / total[h] + sum(map(high, after[h])) / total[h] * lower

    return p, after


def test_language_model_equals_dictionaries_and_beats_unigrams(spark, docs):
    model = ngram_lm.train(docs)
    got = ngram_lm.score(docs, model).collect()
    count = Counter(w for r in docs.collect() for w in [*words(r.text), None])
    n, v = sum(count.values()), len(count)
    assert (model.totals["tokens"], model.totals["types"]) == (n, v)
    sizes = Counter((r.n_tokens, r.n_known) for r in got)
    assert sizes == Counter((len(words(r.text)) + 1,) * 2 for r in docs.collect())
    base = sorted(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in [*words(r.text), None]) for r in docs.collect())
    assert np.allclose(sorted(r.base_score for r in got), base)
    assert sum(r.score for r in got) > sum(base)
    p, contexts = kneser_ney([[*words(r.text), None] for r in docs.collect()])
    kinds = [*count, "never-seen"]
    for h in [BEGIN, "never-seen", *list(contexts)[:50]]:  # a context's probabilities: known words, the end and one unknown word
        assert abs(sum(p(h, w) for w in kinds) - 1) < 1e-9
    probe = spark.createDataFrame([(-1, "w1 never-seen w2"), (-2, "Never"), (-3, None), (-4, "w1 w1 W1")], "doc_id long, text string")
    for rows, scored in ((docs.collect(), got), (probe.collect(), ngram_lm.score(probe, model).collect())):
        want = Counter()
        for r in rows:
            t = [*words(r.text), None]
            want[r.doc_id, round(sum(np.log10(p(h, w)) for h, w in zip([BEGIN, *t], t)), 4)] += 1
        assert Counter((r.doc_id, round(r.score, 4)) for r in scored) == want
    assert ngram_lm.score(docs.limit(0), model).isEmpty()


def test_warc_round_trip(spark):
    rows = [(0, "http://a", "<p>é" * 9000), (1, None, None), (2, "http://b\nx", ""), (3, "u", "<p>é" * 9000), (None, "u", ""), (5, "u", "WARC/1.1\r\n\r\n"), (1, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    area = WorkArea(spark, "warc-test")
    warc.write_archive(pages, area.path("a"), area, segment_chars=1000)
    got = warc.read_archive(spark, area.path("a"), area).collect()
    assert all(r.ok for r in got) and len(got) == len(rows)
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in got) == Counter((i, h or "") for i, _, h in rows)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "revisit", 0), (None, "revisit", 1), (5, "response", None)])
    assert {r.payload_digest for r in got if r.page_id == 2} == {warc.payload_digest(b"")}
    assert warc.unchunk(b"5\r\nabc") is None


def components(rows):
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for r, x in zip(rows, label, strict=True):
        if r.doc_id is not None:
            least[x] = min(least.get(x, r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(s), least.get(x)) for r, s, x in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize("sizes", [{}, {"leaf": 2, "depth": 2, "block": 4}])
def test_near_dedup(docs, sizes):
    got = near_dedup.near_dedup(docs, **sizes).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(docs.collect())


def test_near_dedup_empty(docs):
    assert near_dedup.near_dedup(docs.limit(0)).isEmpty()


def test_chat_template_and_trees(spark):
    said = "</s>[INST] ok [/INST]"
    for t in [said, "\\", "<\\/s>", "<<s>", "a\\</s>\\\\[INST]", "<", "[/INST", ""]:
        assert chat.unescape(chat.escape(t)) == t
        turns = [("system", t), ("user", t), ("assistant", t), ("tool", t), ("<s>", t)]
        formatted, mask = chat.format_turns(turns)
        assert chat.read_turns(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in mask] == [t]
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", None, 0.9), (1, 4, 3, "user", "more", 0.5), (None, 7, 99, None, "alone", None)]
    tree = spark.createDataFrame(rows, "conv long, msg long, parent long, role string, text string, score double")
    got = {(r.conv, r["rank"]): [(t.role, t.text) for t in r.turns] for r in chat.reply_paths(tree, WorkArea(spark, "t"), best=2).collect()}
    assert got[1, 1] == [("user", "q"), ("assistant", None), ("user", "more")]
    assert got[1, 2] == [("user", "q"), ("assistant", "bad")]
    assert got[None, 1] == [(None, "alone")]
    chain = [(c, k, k - 1, "user", f"{c} {k}", float(k)) for c, n in ((1, 37), (2, 1), (3, 8)) for k in range(1, n + 1)] + [(4, 1, 2, "user", "x", 0.0), (4, 2, 1, "user", "y", 0.0)]
    deep = spark.createDataFrame(chain, "conv long, msg long, parent long, role string, text string, score double")
    got = {r.conv: [t.text for t in r.turns] for r in chat.reply_paths(deep, WorkArea(spark, "t"), most_rounds=12).collect()}
    assert got == {c: [f"{c} {k}" for k in range(1, n + 1)] for c, n in ((1, 37), (2, 1), (3, 8))}  # a cycle has no leaf
    twice = deep.unionByName(deep).unionByName(deep.withColumn("text", F.lit("zzz")))
    assert {r.conv: [t.text for t in r.turns] for r in chat.reply_paths(twice, WorkArea(spark, "t")).collect()} == got  # of one id, the least message


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op6_chat(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(by)
    for k, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def cut_by_brute_force(texts, least):
    """(text, removed, longest): all pairs of places; texts in the order of their ids."""
    seqs = [[(k, x) for k, x in enumerate((t or "").split("\n")) if words(x)] for t in texts]
    places = [(d, p) for d, s in enumerate(seqs) for p in range(len(s))]

    def lcp(a, b):
        n = 0
        while a[1] + n < len(seqs[a[0]]) and b[1] + n < len(seqs[b[0]]) and seqs[a[0]][a[1] + n][1] == seqs[b[0]][b[1] + n][1]:
            n += 1
        return n

    gone = {}
    for b in places:
        shared = [(lcp(a, b), a) for a in places if a != b]
        most = max((n for n, _ in shared), default=0)
        originals = [a for n, a in shared if n >= least and a < b]
        if not originals:
            continue
        a = min(originals)
        low = max(b[1], a[1] + least) if a[0] == b[0] else b[1]
        for p in range(low, b[1] + least):
            gone[b[0], p] = max(gone.get((b[0], p), 0), most)
    out = []
    for d, t in enumerate(texts):
        cut = {seqs[d][p][0] for e, p in gone if e == d}
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut) if cut else t
        out.append((kept, len(cut), max((n for (e, _), n in gone.items() if e == d), default=0)))
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_runs_equal_brute_force(spark, least):
    rng = random.Random(least)
    runs = [[f"line {rng.randrange(60)} x" for _ in range(rng.randint(1, 6))] for _ in range(6)]
    texts = [None, "", "\n\n", "a\nb\na\nb\na\nb", "same\nsame\nsame"]
    for k in range(40):
        t = [f"own {k}"]
        for _ in range(rng.randint(0, 4)):
            t += rng.choice([rng.choice(runs), [f"line {rng.randrange(60)} x"], [""], [f"own {k} {rng.random()}"]])
        texts.append("\n".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.removed_lines, r.longest_run) for r in line_runs.drop_repeated_runs(docs, least_lines=least).collect()}
    assert [got[k] for k in range(len(texts))] == cut_by_brute_force(texts, least)


def test_line_runs_rows(spark):
    run = "first line here\n\nsecond line here\nthird"
    rows = [(1, f"own a\n{run}\nend a"), (2, f"own b\n{run}\nend b"), (4, None), (None, run), (2, f"own b\n{run}\nend b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as removed_lines", "1 as longest_run")
    got = {r.doc_id: r for r in line_runs.drop_repeated_runs(docs).collect()}
    assert got[1].text == rows[0][1] and got[4].text is None and got[2].text == "own b\n\nend b" and got[2].longest_run == 3 and got[2].removed_lines == 3
    assert got[None].text == ""
    assert line_runs.drop_repeated_runs(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, " ".join([rng.choice(["sun", "sea", "sky"]) for _ in range(20)] + (["vile"] * 4 if k % 4 == 0 else []))) for k in range(400)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k % 4 == 0 else 0) for k in range(0, 400, 3)], "doc_id long, domain int")
    got = mixing.document_rates(docs, labels, {0: 1.0, 1: 0.25}).collect()
    assert len(got) == 401
    held = [r for r in got if r.id is not None and r.id % 3]
    assert np.mean([(r.p[1] > 0.5) == (r.id % 4 == 0) for r in held]) > 0.95
    vile = [r for r in got if r.id is not None and r.id % 4 == 0]
    assert abs(sum(r.rate for r in vile) / len(vile) - 0.25) < 0.15
    assert min(r.rate for r in got) >= 0
    for k, wanted in enumerate((1.0, 0.25)):
        now = sum(r.tokens * r.p[k] for r in got)
        assert abs(sum(r.tokens * r.p[k] * r.rate for r in got) / now - wanted) < 0.01
    left = mixing.mix(docs, labels, {0: 1.0, 1: 0.0})
    assert left.columns == docs.columns and left.where("doc_id % 4 = 0").count() < 20
    assert mixing.document_rates(docs.limit(0), labels, {0: 1.0, 1: 0.25}).isEmpty()


def test_quality(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.label: tuple(r[n] for n in names) for r in quality.with_features(docs, names).collect()}
    for r in docs.collect():
        t, w = r.text or "", words(r.text, lower=False)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        assert got[r.label] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
    left = quality.keep_good(docs)
    assert left.columns == docs.columns and 0 < left.count() < docs.count()
    assert quality.keep_good(docs.limit(0)).isEmpty()


def test_sharding(spark, docs):
    n = docs.count()
    got = sharding.shuffle_into_shards(docs, 5).collect()
    assert len(got) == n and Counter((r.doc_id, r.label) for r in got) == Counter((r.doc_id, r.label) for r in docs.collect())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shuffle_into_shards(docs.limit(0), 5).isEmpty()
    m = sharding.communication_matrix([10, 0, 7, 3], [7, 7, 6], 1)
    assert m.sum(axis=1).tolist() == [10, 0, 7, 3] and m.sum(axis=0).tolist() == [7, 7, 6]
    draws = [sharding.hypergeometric(np.random.default_rng(k), 6 * 10**8, 6 * 10**8, 1000) for k in range(200)]
    assert abs(np.mean(draws) - 500) < 6 and 10 < np.std(draws) < 22
    p = sharding.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 3, np.uint64))
    assert sorted(p) == list(range(1000))


CLASHES = "id key text_key label p rate copies tokens n_tokens mix_key times maybe near_maybe f_key f_bits f_bucket gone_id row_key cut longest digest keep_id n kept set_id member size n_words n_lines h u i line row pos".split()


def test_extra_columns_of_any_name(spark):
    """Operators that carry rows leave columns alone whose names they use themselves."""
    body = " ".join(f"w{k}" for k in range(40))
    rows = [(1, body), (2, body), (3, body + " x"), (4, None), (None, "a b c"), (6, " ".join(f"v{k}" for k in range(60)))]
    docs = spark.createDataFrame([(*r, *(f"{c}-{r[0]}" for c in CLASHES)) for r in rows], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in CLASHES)]))
    labels = spark.createDataFrame([(1, 0), (6, 1)], "doc_id long, domain int")
    results = {
        "quality": (quality.keep_good(docs), {1, 2, 3, 6}),
        "exact": (exact_dedup.drop_copies(docs, keep="largest"), {2, 3, 4, None, 6}),
        "near": (near_dedup.drop_near_copies(docs), {1, 4, None, 6}),
        "mixing": (mixing.mix(docs, labels, {0: 1.0, 1: 1.0}), {1, 2, 3, 4, None, 6}),
        "bpe": (bpe.encode(docs, RANKS), {1, 2, 3, 4, None, 6}),
        "lines": (line_runs.drop_repeated_runs(docs), {1, 2, 3, 4, None, 6}),
        "sharding": (sharding.shuffle_into_shards(docs, 3), {1, 2, 3, 4, None, 6}),
    }
    for name, (df, kept) in results.items():
        got = df.collect()
        assert {r.doc_id for r in got} == kept, name
        for r in got:
            assert all(r[c] == f"{c}-{r.doc_id}" for c in CLASHES), name


def test_columns_with_the_operators_own_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "i", "d", "s", 5)], "doc_id long, text string, ids string, decoded string, shard string, slot int")
    (r,) = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert len(r.ids) % 4 == 0 and bytes(r.decoded) == b"a b"
    (r,) = sharding.shuffle_into_shards(docs, 1).collect()
    assert (r.shard, r.slot, r.ids) == (0, 0, "i")


def thue_morse(n, flip=0):
    return "".join("ab"[bin(k).count("1") & 1 ^ flip] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_one_value_under_polynomial_hashes(spark, n):
    """The Thue-Morse word and its complement have one value under every polynomial modulo 2**64."""
    x, y = thue_morse(n), thue_morse(n, 1)
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"p q r s {x}"), (4, f"p q r s {y}"), (5, f"{x} {x}")], "doc_id long, text string").coalesce(1)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for r in bpe.encode(docs, RANKS).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text)
    assert all(r.kept for r in near_dedup.near_dedup(docs).collect())
    model = ngram_lm.train(docs.where("doc_id in (1, 3)"))
    known = {r.doc_id: r.n_known for r in ngram_lm.score(docs, model).collect()}
    assert known == {1: 2, 2: 1, 3: 6, 4: 5, 5: 3}


def test_groups_of_one_hash_are_told_apart_by_their_text(monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda points, starts, stops: (stops - starts).astype(np.uint64))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = ["the cat sat", "hat bat the", "", "a b c"]
    for t, ids in zip(texts, bpe._Worker(RANKS).ids(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t)


def test_near_dedup_branches_and_links_families(spark):
    """Families larger than a leaf, with members that are near to the family but not linked; against all pairs."""
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    rows = []
    for f in range(3):
        base = [rng.choice(vocabulary) for _ in range(100)]
        for _ in range(130):
            w = list(base)
            for _ in range(rng.choice([1, 2, 3, 5, 8])):
                w[rng.randrange(100)] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    shared = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    want = components(docs.collect())
    for sizes in ({"leaf": 48, "block": 16, "depth": 3}, {}):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs, **sizes).collect())
        assert sum((got & want).values()) >= (0.99 if sizes else 1) * len(rows)


def test_bigrams_that_the_stored_bits_do_not_tell_apart(spark, monkeypatch):
    """With keys that differ in few bits, many share the stored ones; counts are right all the same."""
    whole = ngram_lm._key
    monkeypatch.setattr(ngram_lm, "_key", lambda c, w: whole(c, w) & np.uint64(0xF0000000000FFFF))
    root = WorkArea(spark, "alike").path("model")
    c, w = np.repeat(np.arange(40, dtype=np.uint64), 40), np.tile(np.arange(40, dtype=np.uint64), 40)
    n = np.arange(1, 1601)
    rows = {"shard": [0], "contexts": [c.tobytes()], "lengths": [np.ones(1600, "<u4").tobytes()], "words": [w.tobytes()], "small": [ngram_lm._pack(n)[0]], "big": [ngram_lm._pack(n)[1]], "docs": [0]}
    list(ngram_lm._merge_shard(root, 1)(iter([pa.RecordBatch.from_pydict(rows, schema=ngram_lm._BLOCKS)])))
    scorer = object.__new__(ngram_lm._Scorer)
    scorer.shards, scorer.bigrams = 1, [ngram_lm._map(f"{root}/bigrams-00000")]
    key = ngram_lm._key(c, w)
    alone = np.array([(key == k).sum() == 1 for k in key])
    assert len(scorer.bigrams[0]["alike"]) > 100 and (scorer.bigram_counts(c, w) == n)[alone].all()
