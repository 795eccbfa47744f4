"""The corpus operators against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmweave.llm import (
    bm25, bpe, decontaminate, graph, jaccard, langmodel, licenses, linededup, quality, suffixes, urlfilter, words,
)
from firmweave.llm.queries import vocabulary_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n string"
EN = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions under a waning moon tonight again"


def docs(spark, texts, schema=SCHEMA):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in texts], schema)


HARD = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "A b"), (5, EN), (5, EN), (6, EN), (7, "ÄÖ É" + EN), (None, EN), (8, "x" * 70_000), (9, "w " * 30_000)]


@pytest.fixture(scope="module")
def hard(spark):
    return docs(spark, HARD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def bytes_words(text, kind=rb"[^\x20\x09-\x0d]+"):
    return re.findall(kind, (text or "").encode().lower())


ALNUM = rb"[0-9a-z\x80-\xff]+"


# Words and sorted arrays


def test_words_equal_a_plain_split():
    texts = [t for _, t in HARD]
    column = pa.array(texts)
    for kind, pattern in ((words.NOT_SPACE, rb"[^\x20\x09-\x0d]+"), (words.ALNUM, ALNUM)):
        found = [list(f.hash[a:b]) for f in words.words(column, kind) for a, b in zip(f.bound[:-1], f.bound[1:])]
        assert found == [[words.word_hash(w) for w in bytes_words(t, pattern)] for t in texts]


def test_mix_is_undone():
    x = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    assert (words.unmix(words.mix(x)) == x).all()


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.u: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}


# 1 licences


def test_license_scan(spark, hard):
    texts = [
        (1, "x CC BY y cc-by z"), (2, "GNU General  Public License; all rights reserved. All Rights Reserved!"), (3, "ccby all rights"),
        (4, "released under the very MIT license"), (5, "This work is licensed under the Apache License, Version 2.0."),
    ]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 4, "cc-by")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 1, 7, "gpl,reserved")
    assert (got[3].n_base, got[3].first_word, got[3].labels) == (0, None, "")
    assert got[5].labels == "apache-2.0" and got[5].base_labels == "" and got[5].score == 1.0
    assert 0 < got[4].score < 1
    rows = licenses.scan(hard).collect()
    assert sorted(r.n_words for r in rows) == sorted(len(bytes_words(t, ALNUM)) for _, t in HARD)


# 2 URLs


def test_url_rules_and_model(spark):
    urls = [
        ("http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.net/es/1#f", "a.net", "/es/1", "net/es/", "block"), ("ftp://b.com", "b.com", "", None, None), ("http://xcom/", "xcom", "/", None, None),
        ("nothing", "", "", None, None), (None, "", "", None, None), ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    parsed = urlfilter.parsed(pages)
    model = urlfilter.fit(pa.array([f"s{i}.net/{'es' if i % 2 else 'de'}/{i}" for i in range(200)]), np.arange(200) % 2.0)
    got = {r.page_id: r for r in urlfilter.judge(parsed, model).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or verdict is None and got[i].verdict in ("allow", "block")
    p = model.block_probability(pa.array(["new.net/es/77", "new.net/de/78"]))
    assert p[0] > 0.5 > p[1]
    assert urlfilter.fit(pa.array([], pa.string()), np.zeros(0)).block_probability(pa.array(["a/"]))[0] == pytest.approx(0.25)


# 3 Jaccard join


def shingles(text, k):
    w = bytes_words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, num, den, k):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    ids = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    return sorted((str(rows[i][0]), len(sets[i]), str(ids[root[i]] if sets[i] else rows[i][0])) for i in range(len(rows)))


@pytest.mark.parametrize("num, k", [(90, 3), (80, 5)])
def test_jaccard_equals_brute_force(spark, num, k):
    rng = np.random.default_rng(num)
    common = [f"c{i}" for i in range(12)]
    rows = list(HARD)
    for base in range(12):
        text = [f"b{base}w{i}" for i in range(int(rng.integers(5, 90)))]
        for c in range(6):
            own = list(text)
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(len(own)))] = f"e{base}{c}{rng.integers(99)}"
            rows.append((100 + base * 10 + c, " ".join(common + own)))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.cluster(docs(spark, rows), num, 100, k).collect())
    assert got == brute_components(rows, num, 100, k)


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"edit{i}"] + base[i + 1 :])) for i in range(40)] + [(99, " ".join(base))]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.cluster(docs(spark, rows)).collect())
    assert got == brute_components(rows, 90, 100, 3)


def test_keep_one(spark, hard, empty):
    found = jaccard.cluster(hard, 80, 100, 5)
    kept = sorted(str(r.doc_id) for r in jaccard.keep_one(hard, found).collect())
    assert kept == sorted(["0", "1", "2", "3", "4", "5", "7", "8", "9", "None"]) or kept == sorted(["0", "1", "2", "3", "4", "5", "8", "9", "None"])
    assert jaccard.cluster(empty).count() == 0


# 4 repeated strings


def brute_repeats(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_equal_brute_force(spark, empty):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared, edge = text(260), text(100)
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 150), (4, text(900)), (4, text(10)), (None, "z" * 205)]
    rows += [(10 + i, text(50 + i) + shared + text(40)) for i in range(6)]
    rows += [(30, edge + "q" * 99 + edge), (31, edge + "q" * 99 + edge), (32, edge + "q" * 99 + edge[:-1])]
    rows += [(40, shared[:200]), (41, shared[1:200] + "!"), (42, text(300) + shared[30:230])]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs(spark, rows).repartition(3)).collect())
    assert got == brute_repeats(rows)
    assert suffixes.remove_repeats(empty).count() == 0


# 5 decontamination


def brute_contamination(rows, items, size=10):
    wins = {}
    for i, t in items:
        w = bytes_words(t, ALNUM)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = bytes_words(t, ALNUM), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def test_contamination_equals_brute_force(spark, hard, empty):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(30)] + ["the"] * 10
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(1, text(25)), (2, "one"), (3, ""), (None, text(11)), (4, None), (5, "the the"), (6, text(10)), (6, text(12))]
    rows = HARD + [(20 + i, text(60) + " " + (items[i % 4][1] or "") + ". " + text(20)) for i in range(8)] + [(40, "THE, the the"), (41, text(400))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    found = decontaminate.contamination(docs(spark, rows), bench)
    named = [(i, t) for i, t in items if i is not None]
    want = {(a, b): (c, d) for a, b, c, d in brute_contamination(rows, items)}
    for r in found.collect():
        n_hit, ids = want[str(r.doc_id), r.n_words]
        assert r.n_hit == n_hit and r["items"] == [x for x in ids if x != "None"]
    assert named and decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(hard, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_near_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = docs(spark, [(1, item), (2, item.replace("gamma", "gamma so")), (3, item.replace("gamma ", "")), (4, "alpha kappa"), (5, item.replace("delta", "x"))])
    wanted = decontaminate.windows(spark.createDataFrame([(7, item)], "item_id bigint, text string"))
    index = decontaminate.postings(rows, wanted.select(F.explode("terms").alias("term")))
    ids = {r.text_key: r.doc_id for r in index.collect()}
    got = {ids[r.text_key]: r.exact for r in decontaminate.matches(index, wanted).collect()}
    assert got[1] and not got[2] and 4 not in got and set(got) <= {1, 2, 3, 5}


def test_near_matches_equal_brute_force(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [item, "one two two one", "solo", "red red blue red green red blue grey red pink black"]
    rng = np.random.default_rng(5)
    texts = [item, item.replace("gamma", "gamma so"), item.replace("gamma ", ""), "alpha kappa", item.replace("delta", "x"), "gamma delta " * 9]
    for _ in range(60):
        w = " ".join(rng.choice(items, 2)).split()
        for _ in range(int(rng.integers(0, 5))):
            k = int(rng.integers(0, len(w)))
            w[k : k + 1] = [[], ["x"], [w[k], "so"], [w[0]]][int(rng.integers(0, 4))]
        texts.append(" ".join(w))
    rows = docs(spark, list(enumerate(texts)))
    wanted = decontaminate.windows(spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    terms = {r.window: [t % 2**64 for t in r.terms] for r in wanted.collect()}
    index = decontaminate.postings(rows, wanted.select(F.explode("terms").alias("term")))
    ids = {r.text_key: texts[r.doc_id] for r in index.collect()}
    for slop, share in ((2, 0.8), (0, 1.0), (1, 0.5)):
        want = set()
        for text in set(texts):
            at = {}
            for k, x in enumerate(text.split()):
                at.setdefault(int(words.word_hash(x.encode())), []).append(k)
            for window, ts in terms.items():
                near = lambda s, d: sum(any(abs(x - s - p) <= d for x in at.get(t, [])) for p, t in enumerate(ts))
                span = range(-len(ts) - slop, len(text.split()) + slop + 1)
                exact = {s for s in span if near(s, 0) == len(ts)}
                want |= {(text, window, s, True) for s in exact}
                want |= {(text, window, s, False) for s in span if near(s, slop) >= math.ceil(share * len(ts)) and not any(abs(s - e) <= slop for e in exact)}
        got = [(ids[r.text_key], r.window, r.start, r.exact) for r in decontaminate.matches(index, wanted, slop, share).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    found = decontaminate.contamination(rows, spark.createDataFrame([(7, item)], "item_id bigint, text string"), near=True)
    got = {r.doc_id: (r.n_hit, r.n_near, r.near_items) for r in found.where("doc_id < 6").collect()}
    assert got == {0: (10, 1, ["7"]), 1: (0, 1, ["7"]), 2: (0, 1, ["7"]), 3: (0, 0, []), 4: (0, 1, ["7"]), 5: (0, 0, [])}


# 6 language model


def brute_model(train):
    streams = [bytes_words(t) + [None] for t in train]
    uni, bi = Counter(w for s in streams for w in s), Counter((v, w) for s in streams for v, w in zip(["^"] + s, s))
    left = Counter(w for _, w in bi)

    def cuts(counts):
        n = [sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
        return [0] + [min(max(d, 0.05), k) for k, d in enumerate(found, 1)]

    d, e, types = cuts(bi), cuts(left), len(uni)
    share = sum(e[min(c, 3)] for c in left.values()) / len(bi) if bi else 1

    def p(v, w):
        low = max(left[w] - e[min(left[w], 3)], 0) / max(len(bi), 1) + share / (types + 1)
        follow = [c for (a, _), c in bi.items() if a == v]
        if not follow:
            return low
        c = bi[v, w]
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in follow) * low) / sum(follow)

    def score(text):
        s = bytes_words(text) + [None]
        base = sum(math.log10((uni[w] + 1) / (sum(uni.values()) + types + 1)) for w in s)
        return len(s), sum(uni[w] > 0 for w in s), base, sum(math.log10(p(v, w)) for v, w in zip(["^"] + s, s))

    return sum(uni.values()), score


def test_model_equals_brute_force(spark, empty):
    rng = np.random.default_rng(6)
    rows = [r for r in HARD if r[0] != 8] + [(20 + i, " ".join(rng.choice([f"w{j}" for j in range(40)], int(rng.integers(1, 80))))) for i in range(25)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    frame = docs(spark, rows)
    from firmweave.llm.common import fold

    model = langmodel.train(frame, ~fold("doc_id", 7, 2))
    total, score = brute_model([t for i, t in rows if not held(i)])
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in langmodel.score(frame, model).collect())
    want = sorted((str(i), *score(t)[:2], total, *score(t)[2:]) for i, t in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)
    untrained = langmodel.train(empty)
    assert langmodel.score(frame.limit(1), untrained).first().score == 0
    assert langmodel.score(empty, model).count() == 0


# 7 search


def test_search_equals_brute_force(spark, monkeypatch, empty):
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "SHARD_DOCS", 16)
    rng = np.random.default_rng(7)
    rows = [r for r in HARD if r[0] is not None] + [(20 + i, " ".join(rng.choice([f"t{int(j * j)}" for j in rng.random(30) * 8], 40))) for i in range(120)]
    frame = docs(spark, rows).repartition(2)
    counts = [Counter(bytes_words(t, ALNUM)) for _, t in rows]
    size = [sum(c.values()) for c in counts]
    df, mean = Counter(w for c in counts for w in c), sum(size) / len(rows)
    want = set()
    for (q, _), own in zip(rows, counts):
        if q % 20 == 0:
            scored = []
            for (i, _), c, n in zip(rows, counts, size):
                s = sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w in own if w in c)
                if s > 0:
                    scored.append((-round(s, 6), i))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:10])}
    got = {tuple(r) for r in bm25.search(bm25.build_index(frame), frame.where(bm25.every_twentieth())).collect()}
    assert {g[:3] for g in got} == {w[:3] for w in want}
    assert sorted(g[3] for g in got) == pytest.approx(sorted(w[3] for w in want), abs=2e-6)
    assert bm25.search(bm25.build_index(empty), empty).count() == 0


@pytest.mark.parametrize("share, dense, pending", [(0.0, 1000, 10), (0.2, 1000, 500), (0.2, 3, 500_000), (2.0, 1000, 500_000)])
def test_search_of_a_block_of_queries_equals_brute_force(monkeypatch, share, dense, pending):
    """Terms as columns, as postings, and some of either; ties; a later shard; a query without hits."""
    for name, value in {"SHARE": share, "DENSE": dense, "FIRST_BLOCKS": 2, "PENDING": pending}.items():
        monkeypatch.setattr(bm25, name, value)
    rng = np.random.default_rng(17)
    given = np.where(rng.random((2, 150, 60)) < np.linspace(0.01, 0.6, 60), np.round(rng.random((2, 150, 60)), 2), 0)
    given[:, 100:] = given[:, 50:100]
    shards = []
    for s, part in enumerate(given):
        term, doc = np.nonzero(part.T)
        shards.append(bm25.shard_of(np.arange(150) * 2 + s, doc, term.astype("<u8"), part.T[term, doc], 8))
    queries = [np.sort(rng.choice(60, int(rng.integers(1, 50)), replace=False)).astype("<u8") for _ in range(20)] + [np.array([99], dtype="<u8"), np.zeros(0, dtype="<u8")]
    best = bm25.no_hits()
    for shard in shards:
        best = bm25.search_shard(shard, queries, 10, best, 8)
    got = [(int(q), int(i), round(float(s), 5)) for q, i, s in zip(*best)]
    want = []
    for q, terms in enumerate(queries):
        hits = [(-round(float(part[d, [t for t in terms if t < 60]].sum()), 6), 2 * d + s) for s, part in enumerate(given) for d in range(150)]
        want += [(q, i, round(-s, 5)) for s, i in sorted(hits)[:10] if s < 0]
    assert got == want


def test_documents_of_alike_terms_share_blocks_of_a_shard():
    """Two vocabularies whose documents take turns: a block holds terms of one of them, so its bounds rule it out for the other's queries."""
    rng = np.random.default_rng(23)
    given = np.where(rng.random((128, 40)) < 0.6, 1 + rng.random((128, 40)), 0)
    given[::2, 20:], given[1::2, :20] = 0, 0
    term, doc = np.nonzero(given.T)
    shard = bm25.shard_of(np.arange(128), doc, term.astype("<u8"), given.T[term, doc], 8)
    most = shard["most"].reshape(16, 40)
    assert not (most[:, :20].any(axis=1) & most[:, 20:].any(axis=1)).any()
    assert sorted(shard["ids"]) == list(range(128))
    for b in range(16):
        assert np.allclose(most[b], given[shard["ids"][b * 8 : b * 8 + 8]].max(axis=0))


def test_search_tells_scores_apart_that_are_equal_in_single_precision():
    given = 100 + np.arange(300)[:, None] * np.array([1e-6, 0, 0, 0, 1e-6]) + np.zeros((300, 5))
    term, doc = np.nonzero(given.T)
    shard = bm25.shard_of(np.arange(300), doc, term.astype("<u8"), given.T[term, doc], 8)
    best = bm25.search_shard(shard, [np.arange(5, dtype="<u8")], 10, bm25.no_hits(), 8)
    assert best.ids.tolist() == list(range(299, 289, -1))
    assert best.scores == pytest.approx([500 + 2e-6 * i for i in range(299, 289, -1)], abs=1e-6)


# 8 tokens


def test_tokens_equal_the_library(spark, hard, empty):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(vocabulary_path())
    extra = ["<|endoftext|>hi<|startoftext|> x", "ΟΔΟΣ ΣΑΣ İ ﬁ ½ é \x1c\x85 c 'S it's IT'LL !!!??? 1234", "a" * 700, "日本語 🙂🙂 \x00", " ss ßẞ ǅ"]
    frame = hard.unionByName(docs(spark, [(50 + i, t) for i, t in enumerate(extra)]))
    path = vocabulary_path()
    got = sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in bpe.decode(bpe.encode(frame, path), path).collect())
    want = []
    for i, t in HARD + [(50 + i, t) for i, t in enumerate(extra)]:
        ids = own.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), tuple(ids), own.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode(empty, path).count() == 0
    odd = spark.createDataFrame([(1, [320, -5, 10**8, None]), (2, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(odd, path).collect()} == {1: own.id_to_token(320), 2: ""}


# 9 lines


def test_boilerplate_lines(spark, empty):
    rows = [(i, "Menu\n  body %d\n\nfooter " % i if i != 3 else "Menu \nfooter\nfooter", "h" if i < 8 else None) for i in range(12)] + [(99, None, "h"), (98, "Menu", "solo")]
    frame = spark.createDataFrame([(i, t, h, "x") for i, t, h in rows], "doc_id bigint, text string, source string, kept string")
    got = {r.page.doc_id: r for r in linededup.drop_boilerplate(frame, F.col("source"), linededup.text_lines("text"), 0.5, 3).collect()}
    assert got[0].kept == ["  body 0", ""] and got[3].kept == [] and got[9].kept == ["  body 9", ""]
    assert got[99].kept is None and got[98].kept == ["Menu"] and got[0].page.kept == "x"
    page = spark.createDataFrame([("<p>a<br>b</p><script>x</script><!-- n --> c <style>q</style>",)], "html string")
    assert page.select(linededup.page_lines("html")).first()[0] == ["a", "b", "c"]
    assert linededup.drop_boilerplate(empty, F.col("source"), linededup.text_lines("text")).count() == 0


# 10 quality


def test_quality_features_and_held_out_accuracy(spark, hard, empty):
    rng = np.random.default_rng(10)
    good = lambda: " ".join(f"{w}{'.' if rng.random() < 0.1 else ''}" for w in rng.choice(EN.split(), 60))
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choice(EN.split(), 60))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (7, 0, 0), (5000, 1, 0)], "doc_id bigint, quality int, toxic int")
    frame = docs(spark, rows)
    model = quality.train(frame, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in quality.score(frame, model).collect()}
    assert all(got[i].quality_label == int(i % 3 > 0) for i in range(0, 300, 5))
    assert all(0 <= r.quality_score <= 1 for r in quality.score(hard, model).collect())
    x = quality.features(pa.array([None, "", "AA bb. 1 1", "ÄÖ"]))
    assert not x[:2].any() and x[2][2] == pytest.approx(0.2) and x[2][11] == pytest.approx(0.25)
    untrained = quality.train(empty, labels)
    assert {r.quality_score for r in quality.score(hard, untrained).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_repeats_of_nul_bytes_and_of_long_texts_equal_brute_force(spark):
    """Runs of NUL bytes, hard texts, and texts that are cut into several slices."""
    rng = np.random.default_rng(21)
    letters = "".join(rng.choice(list("abcdefgh"), 150))
    long = "".join(rng.choice(list("abcdefghij "), 700_000))
    rows = [(100, "\0" * 90 + letters), (101, "x" + "\0" * 90 + letters + "y"), (102, "\0" * 500), (103, "a" + "\0" * 150 + "b"), (104, long + letters * 2 + long[:300]), (105, long[400:900] + "é" * 300), *HARD]
    want = brute_repeats(rows)
    found = suffixes.remove_repeats(docs(spark, rows).repartition(3)).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == want


def test_repeated_queries_count_once_and_one_id_may_ask_twice(spark):
    corpus = docs(spark, [(i, f"w{i % 5} w{i % 7} x") for i in range(40)])
    index = bm25.build_index(corpus)
    one = {tuple(r) for r in bm25.search(index, docs(spark, [(20, "w1 w2")])).collect()}
    assert len(one) == 10 and {tuple(r) for r in bm25.search(index, docs(spark, [(20, "w1 w2")] * 3)).collect()} == one
    other = {tuple(r) for r in bm25.search(index, docs(spark, [(20, "w3")])).collect()}
    both = [tuple(r) for r in bm25.search(index, docs(spark, [(20, "w1 w2"), (20, "w3"), (20, "w3")])).collect()]
    assert sorted(both) == sorted([*one, *other])


def test_one_word_phrases_are_refused(spark, empty):
    with pytest.raises(ValueError, match="two words"):
        licenses.scan(empty, phrases={"copyright": "c"})
    assert licenses.scan(empty).count() == 0


def test_base_columns_of_the_licence_scan_equal_brute_force(spark):
    rng = np.random.default_rng(41)
    bits = ["cc", "BY", "by", "general", "public", "License", "all", "rights", "reserved", "é", "x", "-", ".", "_", "\n"]
    rows = [(i, " ".join(rng.choice(bits, int(rng.integers(0, 40))))) for i in range(300)] + HARD + [(400, "ALL Rights Reserved " * 500)]
    want = []
    for i, t in rows:
        ws = [w.decode() for w in bytes_words(t, ALNUM)]
        found = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(ws)) if ws[p : p + len(phrase.split())] == phrase.split()]
        starts, labels = [p for p, _ in found], sorted({label for _, label in found})
        want.append((str(i), len(ws), len(found), min(starts, default=-1), max(starts, default=-1), ",".join(labels)))
    got = licenses.scan(docs(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels) for r in got) == sorted(want)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_rules_of_the_url_filter_equal_brute_force(spark):
    rng = np.random.default_rng(42)
    hosts, paths = ["example.com", "WWW.Example.com", "a.www.example.com", "notexample.com", "x.net", "net", "org", "com", ""], ["", "/", "/en/", "/en", "/es/a", "/fr/?q=/en/", "/EN/", "/en/b#c"]
    urls = [f"{s}{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http://", "HTTPS://", "", "a://b://") for _ in range(120)] + [None, "", "://", "x://?a", "x://com#/en/"]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in urlfilter.parsed(frame).withColumn("found", urlfilter.rule_for()).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path, host = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0], host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [r for r in urlfilter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (got[i].host, got[i].path, got[i].found) == (host, path, max(fits, key=len, default=None)), u
