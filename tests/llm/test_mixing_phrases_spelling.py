"""Mixing, collocations and spelling variants against brute force, and their edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmweave.llm import collocations, mixing, queries, spelling

SCHEMA = "doc_id bigint, text string, lang string, source string, n string, size string, g string, word string, label string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Documents (id, text, lang, source) with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, "x", "y", "z", "w", "l") for r in rows], SCHEMA)


def texts(seed, n, letters="abc", most=60):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), rng.integers(1, 4))) for _ in range(30)]
    out = []
    for i in range(n):
        marks = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "! "], most, p=[0.7, 0.05, 0.05, 0.08, 0.05, 0.05, 0.02])
        size = int(rng.integers(0, most))
        out.append((i, "".join(words[int(k)] + m for k, m in zip(rng.zipf(1.4, size) % 30, marks)), ["en", "fr", None][i % 3], f"s{i % 4}" if i % 7 else None))
    return out


HARD = [(0, None, None, None), (1, "", "en", ""), (2, " \t\n", "en", "é"), (3, "x" * 70_000, "en", "a"), (4, "w " * 30_000, "und", "a"), (5, "Ab aB", "en", "Z"), (5, "Ab aB", "en", "Z"), (None, "Ab aB", "en", "z")]


# Mixing


def wanted_targets(sizes, most=2.0, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] / total * left > most * sizes[s]}
        if not over:
            out |= {s: weight[s] / total * left for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def check_mix(rows, found):
    size = [len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size):
        total[r[3]] += n
    aims = wanted_targets(total)
    assert sorted((str(r[0]), n, total[r[3]]) for r, n in zip(rows, size)) == sorted((str(r.doc_id), r["size"], r.source_size) for r in found)
    taken = Counter()
    for r in found:
        assert math.isclose(r.target, aims[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    for s in total:
        inside = [n for r, n in zip(rows, size) if r[3] == s and n]
        assert abs(taken[s] - aims[s]) <= max(inside, default=0)
        assert abs(taken[s] - aims[s]) <= min(inside, default=0) or len(inside) < 20


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = texts(1, 400) + texts(1, 20) + HARD
    df = docs(spark, rows).repartition(5)
    found = mixing.mix_sources(df).collect()
    check_mix(rows, found)
    again = mixing.mix_sources(df.repartition(3, "text")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(found, key=key) == sorted(again, key=key)


def test_mix_of_a_hot_cell_is_cut(spark):
    """All rows alike: one source and one size."""
    df = docs(spark, [(i, "a b c", "en", "s") for i in range(900)] + [(1000 + i, "a b", "en", "t") for i in range(900)])
    rows = mixing.sized(df).withColumn("rate", F.lit(0.25) + F.when(F.col("grp") == "0t", 1).otherwise(0))
    by = {r[0]: r[1:] for r in mixing.copies(rows, cell_rows=100).groupBy("grp").agg(F.sum("copies"), F.max("copies"), F.min("copies")).collect()}
    assert by == {"0s": (225, 1, 0), "0t": (1125, 2, 1)}


def test_mix_keeps_means_of_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 40)), "en", f"s{i % 3}") for i in range(300)]
    df = docs(spark, rows)
    found = mixing.mix_sources(df, keep={"score": F.col("doc_id") % 10, "long": F.length("text") / 40})
    sums = found.groupBy("source").agg(
        F.sum(F.col("rate") * F.col("size")).alias("w"), F.first("target").alias("t"), F.sum(F.col("rate") * F.col("size") * (F.col("doc_id") % 10)).alias("z"),
        F.sum(F.col("size") * (F.col("doc_id") % 10)).alias("was"), F.sum("size").alias("size"),
    ).collect()
    for r in sums:
        assert math.isclose(r.w, r.t, rel_tol=1e-6)
        assert math.isclose(r.z / r.w, r["was"] / r["size"], rel_tol=1e-6)


def test_mix_tilts_documents(spark):
    """A mean that differs from the source's own needs rates that differ, as the closed form of two kinds says."""
    cells = spark.createDataFrame([("0s", [0.0], 100), ("0s", [1.0], 300)], "grp string, z array<double>, words bigint")
    aims = spark.createDataFrame([("0s", 400, 100.0)], "grp string, words bigint, target double")
    lam = mixing.dual(cells, aims, 1, 2.0).first().lam
    assert math.isclose(math.exp(lam[0]), 0.25, rel_tol=1e-8) and abs(lam[1]) < 1e-8
    lam, radius, gap = np.zeros(1), 1.0, float("inf")
    for _ in range(60):  # one source that wants nearly the limit
        e = math.exp(lam[0])
        lam, radius, gap = mixing._newton(np.array([199.0]), lam, radius, gap, np.array([100 * min(2, e), 100 * e * (e <= 2 + 1e-9)]), np.array([1.0]), lam[0] - math.log(2))
    assert math.isclose(math.exp(lam[0]), 1.99, rel_tol=1e-9)


def test_mix_of_the_query_tilts_documents(spark, tmp_path):
    """Rates differ by document and make sources alike; words, limit and optimum hold. One source is short of words, one of kinds."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(["é" * int(rng.integers(1, 4)) + "w" * int(rng.integers(1, 3 + i % 4))] * int(rng.integers(1, 40 + 80 * (i % 4 == 1)))), "en", f"s{i % 4}") for i in range(600)]
    rows += [(700, "alone here", "en", "z"), (701, None, None, "s1"), (702, " ", "en", None), (703, "x" * 900, None, None), (rows[0][0], *rows[0][1:]), (None, "a b c", None, "s2")]
    docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_mix_sources(spark, str(tmp_path)).collect()
    taken, aims = Counter(), {}
    for r in found:
        assert 0 <= r.rate <= 2 and r.copies <= 2 and r.taken == r.copies * r["size"]
        aims[r.target, r.source_size] = r.target
        taken[r.target, r.source_size] += r.rate * r["size"]
    for s in aims:
        assert math.isclose(taken[s], aims[s], rel_tol=1e-6)
    # The optimum itself, from rates alone: log odds are linear in the columns, and slopes are what is missing.
    text = {r[0]: r[1] or "" for r in rows}
    kept = [r for r in found if r["size"]]
    n = np.array([r["size"] for r in kept])
    step = lambda x, k: math.floor(x * k + 0.5) / k
    z = np.array([[step(math.log2(len(text[r.doc_id]) + 1), 4), min(step(len(text[r.doc_id]) / r["size"], 4), 32),
                   step(len(text[r.doc_id].encode()) / len(text[r.doc_id]), 32)] for r in kept])
    mean = n @ z / n.sum()
    z = np.clip((z - mean) / np.sqrt(n @ (z - mean) ** 2 / n.sum()), -3, 3)
    rate = np.array([r.rate for r in kept])
    differ = 0
    for s in aims:
        own = np.array([(r.target, r.source_size) == s for r in kept])
        if own.sum() < 50 or rate[own].min() == 2:
            continue
        differ += len(set(rate[own])) > 20
        was = n[own] @ z[own] / n[own].sum()
        x = np.c_[np.ones(own.sum()), z[own] - was]
        lam, *_ = np.linalg.lstsq(x, np.log(rate[own] / (2 - rate[own])), rcond=None)
        assert np.allclose(x @ lam, np.log(rate[own] / (2 - rate[own])), atol=1e-6)
        now = (n[own] * rate[own]) @ x[:, 1:] / aims[s]
        assert np.allclose(now - np.clip(-was, -0.5, 0.5), -0.1 * lam[1:], atol=1e-6)
        assert np.linalg.norm(now + was) < np.linalg.norm(was)
    assert differ >= 2


def test_mix_refuses_targets_out_of_reach(spark):
    cells = spark.createDataFrame([("0s", [], 100)], "grp string, z array<double>, words bigint")
    aims = spark.createDataFrame([("0s", 100, 300.0)], "grp string, words bigint, target double")
    with pytest.raises(ValueError, match="aren't met"):
        mixing.dual(cells, aims, 0, 2.0)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    found = mixing.mix_sources(docs(spark, [(1, None, None, None), (2, " ", "en", "s")])).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.copies) for r in found) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# Collocations


def mined(rows, most=3, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, most + 1):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i : i + m])] += 1
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cands.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        scored = []
        for p, a in cands.items():
            if 100 * longer[p] >= share * a and longer[p]:
                continue
            s, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found_phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("budget", [1_000_000, 400, 40])
def test_phrases_equal_brute_force_at_every_budget(spark, budget):
    """Small budgets lengthen prefixes to pairs and to whole suffixes."""
    rows = texts(2, 300) + HARD
    assert found_phrases(collocations.mine(docs(spark, rows).repartition(4), budget=budget)) == mined(rows)


def test_longer_phrases_and_ties(spark):
    rows = texts(4, 150, "ab", 30)
    want = mined(rows, most=4, least=3, share=80, top=25)
    assert found_phrases(collocations.mine(docs(spark, rows), 4, 3, 80, 25)) == want
    assert found_phrases(collocations.mine(docs(spark, rows), 4, 3, 80, 25, budget=30)) == want


def test_no_phrase_crosses_a_piece_or_a_document(spark):
    rows = [(i, t, "en", "s") for i in range(12) for t in ("A b", "c.d e", "f\x0bg")]
    assert [r[2] for r in found_phrases(collocations.mine(docs(spark, rows)))] == ["a b", "d e"]


def test_phrases_of_nothing(spark):
    assert collocations.mine(docs(spark, [])).count() == 0
    assert collocations.mine(docs(spark, HARD[:3])).count() == 0


def test_scores_pass_64_bits(spark):
    a = 3_000_000_000_000
    one = spark.createDataFrame([([1, 2], a, 2 * a, a + 1)], "ids array<bigint>, a bigint, f_first bigint, f_last bigint")
    assert collocations.lowest_cut(one).first().score == 1000000 * a * a // (2 * a * (a + 1))


# Spelling variants


def near(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def variants(rows):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by, out = {w: [v for v in n if near(w, v)] for w in n}, {}
    for w in n:
        best = min(by[w], key=lambda v: (-n[v], v), default=None)
        out[w] = best if best is not None and n[best] >= 2 * n[w] else None
    def root(w):
        while out[w] is not None:
            w = out[w]
        return w
    return sorted((w, out[w] or "", root(w), n[w], len(by[w]), n[out[w]] if out[w] else -1) for w in n)


def spelled(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def misspelt(seed, n):
    rng = np.random.default_rng(seed)
    base = ["straße", "élève", "Ελλάδα", "banana", "bananas", "aaaaa", "aaaaaa", "aaaaaaa", "über×alles", "naïveté", "letters", "lettres", "abcdefghijklmnop"]
    def one():
        w = base[int(min(rng.zipf(1.5), len(base)) - 1)]
        while rng.random() < 0.5:
            at, kind = int(rng.integers(0, len(w))), rng.integers(0, 3)
            c = "abeéß"[int(rng.integers(0, 5))]
            w = w[:at] + (w[at + 1 :] if kind == 0 else c + w[at + (kind == 1) :])
            w = w or "a"
        return w
    return [(int(i), "".join(one() + " 1.\n-"[int(rng.integers(0, 5))] for _ in range(int(rng.integers(0, 60)))), "en", "s") for i in range(n)]


@pytest.mark.parametrize("symbols", [12, 2])
def test_variants_equal_brute_force(spark, symbols):
    rows = misspelt(5, 400) + HARD + [(i, "Z" * 3000 + " " + "z" * 2999, "en", "s") for i in range(3)]
    assert spelled(spelling.group_variants(docs(spark, rows).repartition(4), symbols=symbols)) == variants(rows)


def test_chains_of_forms_end_at_their_root(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbb"]
    text = " ".join(" ".join([w] * (3 * 3**i)) for i, w in enumerate(words))
    found = {r.word: (r.form, r.root) for r in spelling.group_variants(docs(spark, [(1, text, "en", "s")]), every=0).collect()}
    assert found == {w: (words[i + 1] if i < 6 else None, "bbbbbb") for i, w in enumerate(words)}


def test_crc_of_runs():
    raw = np.frombuffer(b"abc" + b"q" * 200, dtype=np.uint8)
    seeds = np.array([zlib.crc32(b"7:"), zlib.crc32(b":")], dtype=np.uint32)
    assert spelling.crc32_of(seeds, raw, np.array([0, 3]), np.array([3, 203])).tolist() == [zlib.crc32(b"7:abc"), zlib.crc32(b":" + b"q" * 200)]


def test_variants_of_nothing(spark):
    assert spelling.group_variants(docs(spark, [])).count() == 0
    assert spelling.group_variants(docs(spark, HARD[:3])).count() == 0
