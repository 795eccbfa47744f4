"""Exact top-k search by BM25: an inverted index in shards, block-max pruning per shard, one exact merge.

A first pass counts, over all documents, their number, their words and the documents of every term; these global figures
make scores of different shards comparable. A second pass cuts the documents into shards of bounded size, in the
task that reads them. A shard's files hold the postings of its rarer terms by term, and those of its frequent terms (of at least
``SHARE`` of its documents, ``DENSE`` at most) by blocks of ``BLOCK`` documents, with the largest contribution of each to a block.
Documents of alike frequent terms stand together in a shard, so that a block holds few of them and its maxima are close. Queries are
long, and most of their postings belong to few terms. So for a query the postings of its rarer terms are summed, which costs little, and
the block maxima of its frequent terms are added to the largest such sum of a block: this bounds every score in the block. The best
blocks are opened first, then all whose bound reaches the k-th score so far, which a task carries from shard to shard. To open a block
is to add what its frequent terms give, as one product of matrices for all queries that need the block: in single precision, then
in double precision for the queries with a hit that reaches the k-th score within the error of the first.
A query's best of all shard runs are then ranked.

    score = sum over the query's distinct terms of ln(1 + (N - n + 0.5) / (n + 0.5)) * f (k1 + 1) / (f + k1 (1 - b + b d / mean d))

Scores are rounded to six digits; ties go to the smaller id. Only documents that share a term are results.

Edge cases: rows without an id take no part; null and wordless texts count as documents and find nothing; repeated
rows are documents of their own.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmweave.llm import arrays
from firmweave.llm.common import prepare
from firmweave.llm.words import ALNUM, words
from firmweave.session import staged

K1, B = 1.2, 0.75
BLOCK, SHARD_DOCS, SHARD_POSTINGS, QUERIES_PER_BLOCK, RUNS = 64, 16_384, 4_000_000, 1000, 2
SHARE, DENSE, FIRST_BLOCKS, PENDING = 1 / 32, 2048, 4, 500_000
GROUPS, GROUP_TERMS, ROUNDS = 16, 512, 4
DTYPES = {
    "ids": "<i8", "terms": "<u8", "starts": "<i8", "frequent": "<i8", "most": "<f4", "doc": "<i4", "part": "<f8",
    "block_starts": "<i8", "spot": "<i4", "block_part": "<f8",
}


def _counts(found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of every posting of a slice, by row and term."""
    row = np.repeat(np.arange(len(found.bound) - 1), np.diff(found.bound))
    order = np.lexsort((found.hash, row))
    h, r = found.hash[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
    return r[first], h[first], np.diff(np.append(first, len(h)))


class Index(NamedTuple):
    shards: DataFrame  # run, names: one row per shard
    uri: str
    runs: int


def alike(n: int, doc: np.ndarray, column: np.ndarray, part: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """The documents in an order that puts those of alike terms together: a few rounds of k-means, then by postings.

    ``uses`` are those of each column; the ``GROUP_TERMS`` most used ones decide. Each group is followed by the most alike of those left.
    """
    taken = np.full(len(uses), -1)
    best = np.argsort(-uses, kind="stable")[:GROUP_TERMS]
    taken[best] = np.arange(len(best))
    own = taken[column] >= 0
    rows = np.zeros((n, len(best)), dtype=np.float32)
    rows[doc[own], taken[column[own]]] = part[own]
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    middles = rows[np.linspace(0, n - 1, min(GROUPS, n)).astype(np.int64)]
    for _ in range(ROUNDS):
        group = np.argmax(rows @ middles.T, axis=1)
        sums = (group == np.arange(len(middles))[:, None]).astype(np.float32) @ rows
        middles = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    near, rank, last = middles @ middles.T, np.zeros(len(middles), dtype=np.int64), 0
    for i in range(1, len(middles)):
        near[:, last] = -1
        last = int(np.argmax(near[last]))
        rank[last] = i
    return np.lexsort((np.bincount(doc, minlength=n), rank[np.argmax(rows @ middles.T, axis=1)]))


def shard_of(ids: np.ndarray, doc: np.ndarray, term: np.ndarray, part: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """The arrays of a shard in blocks of ``size``, from its postings by term and document.

    ``spot`` is where a frequent term's posting stands in the matrix of its block, whose columns are the terms with a ``most`` there.
    """
    n, n_blocks = len(ids), -(-len(ids) // size)
    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])[: len(term)])
    uses = np.diff(np.append(start, len(term)))
    frequent = np.argsort(-uses, kind="stable")[:DENSE]
    frequent = np.sort(frequent[uses[frequent] >= SHARE * n])
    column = np.full(len(start), -1)
    column[frequent] = np.arange(len(frequent))
    columns = np.repeat(column, uses)
    dense = columns >= 0
    if len(frequent):
        order = alike(n, doc[dense], columns[dense], part[dense], uses[frequent])
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        ids, doc = ids[order], place[doc]
    block, row = np.divmod(doc[dense].astype(np.int64), size)
    cell = block * len(frequent) + columns[dense]
    by_cell = np.argsort(cell, kind="stable")
    cell, block, row, block_part = cell[by_cell], block[by_cell], row[by_cell], part[dense][by_cell]
    new = np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)]
    first = np.flatnonzero(new)
    most = np.zeros(n_blocks * len(frequent))
    most[cell[first]] = np.maximum.reduceat(block_part, first) if len(first) else 0
    width = np.bincount(block[first], minlength=n_blocks)
    spot = row * width[block] + np.cumsum(new) - 1 - (np.cumsum(width) - width)[block]
    return {
        "ids": ids, "terms": term[start], "starts": np.append(0, np.cumsum(np.where(column < 0, uses, 0))), "frequent": frequent,
        "most": most.astype(np.float32), "doc": doc[~dense], "part": part[~dense],
        "block_starts": np.searchsorted(block, np.arange(n_blocks + 1)), "spot": spot, "block_part": block_part,
    }


def statistics(docs: DataFrame) -> arrays.Sorted:
    """Per term its documents and uses; at key 0 the documents and words of the corpus."""
    bits = arrays.bits_for(docs.rdd.getNumPartitions() * 100_000)

    def work(batches):
        sums = arrays.Sums(bits, 2)
        for batch in batches:
            for found in words(batch.column(0), ALNUM):
                _, term, uses = _counts(found)
                yield from sums.add(
                    np.append(term, np.uint64(0)),
                    [np.append(np.ones(len(term), dtype=np.int64), len(found.bound) - 1), np.append(uses, len(found.hash))],
                )
        yield from sums.rest()

    return arrays.build(
        docs.select("text").mapInArrow(work, arrays.BLOCKS), bits, arrays.shared_uri(docs.sparkSession, "bm25-terms"), ("<u8", "<i8", "<i8"), lambda k, v: []
    )[0]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("bigint").alias("id"))
    known = statistics(docs)
    n_docs, n_words = (int(x[0]) for x in known.find(np.zeros(1, dtype=np.uint64), (1, 2))[1])
    mean = max(n_words, 1) / max(n_docs, 1)
    uri = arrays.shared_uri(spark, "bm25-shards")

    def write(ids, length, doc, term, uses) -> pa.RecordBatch:
        ids, length, doc, term, uses = (np.concatenate(x) for x in (ids, length, doc, term, uses))
        order = np.lexsort((doc, term))
        doc, term, uses = doc[order], term[order], uses[order]
        n = known.find(term, (1,))[1][0]
        part = np.log(1 + (n_docs - n + 0.5) / (n + 0.5)) * uses * (K1 + 1) / (uses + K1 * (1 - B + B * length[doc] / mean))
        found = shard_of(ids, doc, term, part, BLOCK)
        names = [arrays.save(uri, found[k].astype(d)) for k, d in DTYPES.items()]
        return pa.RecordBatch.from_pydict({"names": pa.array([names], pa.list_(pa.string()))})

    def work(batches):
        held, n_held, postings = ([], [], [], [], []), 0, 0
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for found in words(batch.column(0), ALNUM):
                rows = len(found.bound) - 1
                row, term, uses = _counts(found)
                for x, y in zip(held, (ids[found.first_row : found.first_row + rows], np.diff(found.bound), row + n_held, term, uses)):
                    x.append(y)
                n_held, postings = n_held + rows, postings + len(term)
                if n_held >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield write(*held)
                    held, n_held, postings = ([], [], [], [], []), 0, 0
        if n_held:
            yield write(*held)

    made = staged(docs.mapInArrow(work, "names array<string>"))
    runs = max(1, min(RUNS, made.count()))
    shards = staged(made.withColumn("run", F.pmod(F.xxhash64("names"), F.lit(runs)).cast("int")))
    return Index(shards, uri, runs)


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one after the other."""
    size = stop - start
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


class Best(NamedTuple):
    """The best hits of a block of queries so far: query (its number in the block), id, score, by query, falling score and id."""

    query: np.ndarray
    ids: np.ndarray
    scores: np.ndarray


def best_of(parts: list[Best], k: int) -> Best:
    query, ids, scores = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, -scores, query))
    query = query[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, dtype=np.int64)
    kept = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
    return Best(query[kept], ids[order][kept], scores[order][kept])


def no_hits() -> Best:
    return Best(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def least_scores(best: Best, n: int, k: int) -> np.ndarray:
    """What a score must reach to be among the best k of each query, less the rounding; 0 for a query with fewer hits."""
    out = np.zeros(n)
    full = np.flatnonzero(np.bincount(best.query, minlength=n) >= k)
    out[full] = best.scores[np.searchsorted(best.query, full, side="right") - 1] - 1e-6
    return out


class Asked(NamedTuple):
    """The terms of a block of queries, each once and sorted, and for every term of a query (its number in the block) the place among them."""

    n: int
    terms: np.ndarray
    query: np.ndarray
    place: np.ndarray


def asked_by(queries: list[np.ndarray]) -> Asked:
    terms, place = np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *queries]), return_inverse=True)
    return Asked(len(queries), terms, np.repeat(np.arange(len(queries)), [len(q) for q in queries]), place)


def search_shard(shard: dict[str, np.ndarray], queries: Asked | list[np.ndarray], k: int, best: Best, size: int) -> Best:
    """The best k of those so far and of a shard in blocks of ``size``, by rounded score and id, for each of some queries (sorted terms)."""
    own = queries if isinstance(queries, Asked) else asked_by(queries)
    ids, terms, frequent, part, block_starts, spot, block_part = (
        np.asarray(shard[c]) for c in ("ids", "terms", "frequent", "part", "block_starts", "spot", "block_part")
    )
    n = len(ids)
    if not n or not len(terms) or not own.n:
        return best
    doc, begin, end = np.asarray(shard["doc"]).astype(np.int64), np.asarray(shard["starts"][:-1]), np.asarray(shard["starts"][1:])
    column = np.full(len(terms), -1)
    column[frequent] = np.arange(len(frequent))
    n_blocks = -(-n // size)
    most = np.asarray(shard["most"], dtype=np.float32).reshape(n_blocks, len(frequent))

    found = np.searchsorted(terms, own.terms)
    found[found == len(terms)] = 0
    found[terms[found] != own.terms] = -1
    place, query = found[own.place], own.query
    place, query = place[place >= 0], query[place >= 0]
    is_frequent = column[place] >= 0
    asked, rare = np.zeros((own.n, len(frequent)), dtype=np.float32), np.zeros((own.n, n))
    asked[query[is_frequent], column[place[is_frequent]]] = 1
    place, query = place[~is_frequent], query[~is_frequent]
    cut = np.searchsorted(query, np.arange(own.n + 1))
    docs_here, parts_here = np.empty(len(doc), dtype=np.int64), np.empty(len(doc))  # filled anew for each query: cheaper than new arrays
    for i in range(own.n):
        mine = place[cut[i] : cut[i + 1]]
        posting = _ranges(begin[mine], end[mine])
        m = len(posting)
        np.take(doc, posting, out=docs_here[:m], mode="clip")
        np.take(part, posting, out=parts_here[:m], mode="clip")
        rare[i] = np.bincount(docs_here[:m], parts_here[:m], minlength=n)
    # All parts are above 0, so a sum of m of them in single precision is off by less than the share m * 2 ** -23 of itself.
    above = 1 + (len(frequent) + 2) * 2.0**-23
    bound = (asked @ most.T) * above + np.maximum.reduceat(rare, np.arange(0, n, size), axis=1)

    least, parts, held = least_scores(best, own.n, k), [best], 0
    first = np.argpartition(-bound, min(FIRST_BLOCKS, n_blocks) - 1, axis=1)[:, :FIRST_BLOCKS]
    early = np.zeros(bound.shape, dtype=bool)
    np.put_along_axis(early, first, True, axis=1)
    for wave in (early, ~early):
        for b in range(n_blocks):
            need = np.flatnonzero(wave[:, b] & (bound[:, b] > 0) & (bound[:, b] >= least))
            if not len(need):
                continue
            here = slice(b * size, min((b + 1) * size, n))
            columns, held_here = np.flatnonzero(most[b]), slice(block_starts[b], block_starts[b + 1])
            given = np.zeros((here.stop - here.start) * len(columns))
            given[spot[held_here]] = block_part[held_here]
            given = given.reshape(here.stop - here.start, len(columns))
            chosen = asked[need][:, columns]
            rough = (chosen @ given.astype(np.float32).T) * above + rare[need, here]
            highest = rough.max(axis=1)
            hopeful = np.flatnonzero((highest > 0) & (highest >= least[need]))
            need = need[hopeful]
            scores = rare[need, here] + chosen[hopeful].astype(np.float64) @ given.T
            row, at = np.nonzero((scores > 0) & (scores >= least[need, None]))
            parts.append(Best(need[row], ids[here][at], np.round(scores[row, at], 6)))
            held += len(row)
            if held > PENDING:
                parts, held = [best_of(parts, k)], 0
                least = least_scores(parts[0], own.n, k)
        parts, held = [best_of(parts, k)], 0
        least = least_scores(parts[0], own.n, k)
    return parts[0]


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``query_id``, ``rank``, ``doc_id``, ``score`` of the best k documents for every query with an id.

    Rows that repeat id and text are one query; rows of one id with different texts are queries of their own, each with k hits.
    """
    spark = queries.sparkSession
    uri, shard_uri = arrays.shared_uri(spark, "bm25-queries"), index.uri
    text = F.col(text_col).cast("string")
    rows = queries.where(F.col(id_col).isNotNull()).select(text.alias("text"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("key"))
    rows = rows.dropDuplicates(["id", "key"])

    def write(ids, keys, terms) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
        names = [arrays.save(uri, np.array(ids, dtype="<i8")), arrays.save(uri, ends.astype("<i8")), arrays.save(uri, np.concatenate(terms).astype("<u8")), arrays.save(uri, np.array(keys, dtype="<i8"))]
        return pa.RecordBatch.from_pydict({"query": pa.array([names], pa.list_(pa.string()))})

    def pack(batches):
        ids, keys, terms = [], [], []
        for batch in batches:
            own, own_keys = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for found in words(batch.column(0), ALNUM):
                for r, (a, b) in enumerate(zip(found.bound[:-1], found.bound[1:])):
                    ids.append(own[found.first_row + r])
                    keys.append(own_keys[found.first_row + r])
                    terms.append(np.unique(found.hash[a:b]))
                    if len(ids) >= QUERIES_PER_BLOCK:
                        yield write(ids, keys, terms)
                        ids, keys, terms = [], [], []
        if ids:
            yield write(ids, keys, terms)

    blocks = staged(rows.mapInArrow(pack, "query array<string>"))
    # The stated queries against all documents, in blocks: about one task for each block of queries and run of shards. Runs are few, so
    # that a task knows high scores early and the hits it passes on grow with the queries only; it holds one shard at a time.
    pairs = blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(index.runs - 1)))).join(
        index.shards.groupBy("run").agg(F.collect_list("names").alias("shards")), "run"
    )
    tasks = pairs.select("query", "shards").repartition(max(spark.sparkContext.defaultParallelism, blocks.count() * index.runs))

    def work(batches):
        for batch in batches:
            for query, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q_ids, ends, terms, keys = (arrays.load(f"{uri}/{n}", d) for n, d in zip(query, ("<i8", "<i8", "<u8", "<i8")))
                asked, best = asked_by([np.asarray(terms[a:b]) for a, b in zip(ends[:-1], ends[1:])]), no_hits()
                for own in names:
                    shard = {c: arrays.load(f"{shard_uri}/{n}", d) for n, (c, d) in zip(own, DTYPES.items())}
                    best = search_shard(shard, asked, k, best, BLOCK)
                found = (q_ids[best.query], keys[best.query], best.ids, best.scores)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "key", "doc_id", "score"])

    best = tasks.mapInArrow(work, "query_id bigint, key bigint, doc_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def every_twentieth(id_col: str = "doc_id") -> Column:
    return F.col(id_col) % 20 == 0
