"""Exact Jaccard self-join of word shingles by a token-group matrix, and the components it links.

1. Every text becomes the set of its hashed shingles; texts with equal sets form one class. Tokens are counted over
   all texts (by a hash prefix that grows with the corpus, so a count may only be too high) as blocks, not rows.
2. Similar sets are put into groups. Two sets of similarity t share a token among the rarest n - ceil(t n) + 1 of
   either, in any fixed order of tokens. Sets that share such a rare token, rarest first, meet in a group named by the
   smallest class that holds it. Tokens that occur once make no group, so a text without near copies has none.
3. A group stores the union of its members' tokens with the number of holders. A member's overlap with the
   others' union bounds its overlap with each of them: a member below the threshold isn't opened.
4. Opened members are compared exactly. A group is split into chunks and each pair of chunks is a task of its
   own, so no task holds a large group.
5. Links become components; sets are read again from the texts only for classes that are in some group.

Tokens and classes are 64-bit hashes. Nothing is capped, and no pair above the threshold is lost.

Edge cases: a text with fewer words than a shingle is one shingle, a text without words (or null) has the empty set
and links with nothing; equal rows are copies; a null id never becomes a component's id unless there is no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmweave.llm import arrays
from firmweave.llm.common import give_back, prepare
from firmweave.llm.graph import components
from firmweave.llm.words import NOT_SPACE, chain, mix, words
from firmweave.session import staged

CHUNK = 256  # members of a group that one side of a task holds
TOKENS_PER_PARTITION = 4_000_000
HELD, PENDING = 200_000, 600_000  # tokens of sets a worker holds at once, and counts before it passes them on


def shingle_sets(column: pa.Array, size: int):
    """For each row, its sorted distinct shingle hashes."""
    for found in words(column, NOT_SPACE):
        h, bound = found.hash, found.bound
        whole = chain([h[i : len(h) - size + 1 + i] for i in range(size)]) if len(h) >= size else h[:0]
        for a, b in zip(bound[:-1], bound[1:]):
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            elif b > a:
                yield chain([h[i : i + 1] for i in range(a, b)])
            else:
                yield h[:0]


def held_sets(column: pa.Array, size: int):
    """First row and sets of consecutive rows, as many at a time as a worker should hold."""
    first, row, sets, held = 0, 0, [], 0
    for s in shingle_sets(column, size):
        sets.append(s)
        held += len(s)
        row += 1
        if held > HELD:
            yield first, sets
            first, sets, held = row, [], 0
    if sets:
        yield first, sets


def class_key(tokens: np.ndarray) -> np.int64:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        return mix(mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0]


def rarest(tokens: np.ndarray, uses: np.ndarray, num: int, den: int) -> np.ndarray:
    """The repeated ones among the tokens of which a linked set must share one."""
    n = len(tokens)
    first = np.lexsort((tokens, uses))[: n - (-(-n * num // den)) + 1]
    return tokens[first[uses[first] > 1]]


def links(keys: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links among some members of a group that hold its components together: each member with the smallest it reaches."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = holders[token] > 1
    bound = np.bincount(owner[shared], minlength=len(sets))
    opened = np.flatnonzero(bound * den >= size * num)
    if len(opened) < 2:
        return []
    row = np.full(len(sets), -1)
    row[opened] = np.arange(len(opened))
    use = shared & (row[owner] >= 0)
    _, column = np.unique(token[use], return_inverse=True)
    member = row[owner[use]]
    both = np.zeros((len(opened), len(opened)))
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    for first in range(0, int(column[-1]) + 1, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        block = np.zeros((len(opened), min(4096, int(column[-1]) + 1 - first)), dtype=np.float32)
        block[member[a:b], column[a:b] - first] = 1
        both += block @ block.T
    n = size[opened]
    near = both * (den + num) >= num * (n[:, None] + n[None, :])
    left, out, own = np.ones(len(opened), dtype=bool), [], keys[opened]
    for i in np.argsort(own, kind="stable"):
        if left[i]:
            left[i], edge = False, [i]
            while edge:
                new = np.flatnonzero(near[edge].any(axis=0) & left)
                left[new] = False
                out += [(int(own[x]), int(own[i])) for x in new]
                edge = new.tolist()
    return out


def groups(rare: DataFrame) -> DataFrame:
    """``pivot``, ``key``: the members of every group of at least two classes, given ``key`` and ``token`` rows."""
    shared = rare.groupBy("token").agg(F.min("key").alias("pivot"), F.max("key").alias("last")).where("pivot <> last")
    return rare.join(shared.select("token", "pivot"), "token").select("pivot", "key").distinct()


def cluster(
    docs: DataFrame, num: int = 90, den: int = 100, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: its id, ``n_shingles`` and ``component_id``; sets link at a similarity of num / den or more."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("text_key"), F.col(id_col).alias("id"))
    id_type = rows.schema["id"].dataType.simpleString()

    # Tokens are counted by 5 bits more than their number has; files have a few hundred thousand keys.
    tokens = rows.rdd.getNumPartitions() * TOKENS_PER_PARTITION
    count_bits = min(64, 5 + int(np.ceil(np.log2(tokens))))
    mask, bits = np.uint64(((1 << count_bits) - 1) << (64 - count_bits)), arrays.bits_for(tokens)

    def sketch(batches):
        sums = arrays.Sums(bits, 1, PENDING)

        def blocks(found):
            for b in found:
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, own_type), none, none, none, *b.columns], names=[*names, "shard", "blob"])

        names, own_type = ["id", "text_key", "n", "key"], None
        for batch in batches:
            own_type = batch.schema.types[2]
            for first, sets in held_sets(batch.column(0), shingle):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(sets)) for c in (2, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(class_key(s)) for s in sets], pa.int64()),
                     pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.list_(pa.binary()))],
                    names=[*names, "shard", "blob"],
                )
                keys = np.concatenate(sets) & mask
                for part in range(0, len(keys), PENDING):
                    some = keys[part : part + PENDING]
                    yield from blocks(sums.add(some, [np.ones(len(some), dtype=np.int64)]))
        if own_type is not None:
            yield from blocks(sums.rest())
        give_back()

    both = staged(rows.mapInArrow(sketch, f"id {id_type}, text_key bigint, n bigint, key bigint, {arrays.BLOCKS}"))
    sketched = both.where("shard is null").select("id", "text_key", "n", "key")
    uses, _ = arrays.build(
        both.where("shard is not null").select("shard", "blob"), bits, arrays.shared_uri(spark, "jaccard-tokens"), ("<u8", "<u4"), lambda k, v: [],
        keep=lambda v: v[0] > 1,
    )

    def pick(batches):
        for batch in batches:
            for _, sets in held_sets(batch.column(0), shingle):
                found = np.maximum(uses.find(np.concatenate(sets) & mask, (1,))[1][0], 1)
                ends = np.cumsum([len(s) for s in sets])
                few = [rarest(s, found[e - len(s) : e], num, den) for s, e in zip(sets, ends)]
                keys = np.repeat(np.array([class_key(s) for s in sets]), [len(f) for f in few])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(few).view(np.int64))], names=["key", "token"])
        give_back()

    grouped = staged(groups(staged(rows.select("text").mapInArrow(pick, "key bigint, token bigint"))))

    # One text for each class in a group; workers look its hash up in a sorted array.
    asked = grouped.select("key").distinct().join(sketched.groupBy("key").agg(F.min("text_key").alias("text_key")), "key")
    bits = arrays.bits_for(grouped.count())

    def to_blocks(batches):
        sums = arrays.Sums(bits, 1)
        for batch in batches:
            keys = mix(batch.column(0).to_numpy().view(np.uint64))
            yield from sums.add(keys, [np.ones(len(keys), dtype=np.int64)])
        yield from sums.rest()

    wanted, _ = arrays.build(
        asked.select("text_key").mapInArrow(to_blocks, arrays.BLOCKS), bits, arrays.shared_uri(spark, "jaccard-texts"), ("<u8", "<i8"), lambda k, v: []
    )

    def read_sets(batches):
        seen: set[int] = set()
        for batch in batches:
            text_key = batch.column(1).to_numpy()
            here = np.flatnonzero(wanted.find(mix(text_key.view(np.uint64)))[0] >= 0)
            new = [int(i) for i in here if not (text_key[i] in seen or seen.add(text_key[i]))]
            for _, found in held_sets(batch.column(0).take(pa.array(new, pa.int64())), shingle):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(class_key(s)) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "tokens"]
                )
        give_back()

    sets = rows.select("text", "text_key").mapInArrow(read_sets, "key bigint, tokens binary").dropDuplicates(["key"])
    chunks = grouped.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    tasks = grouped.join(chunks, "pivot").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tasks = tasks.select("key", "pivot", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def compare(found: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in found.column("tokens").to_pylist()]
        edges = links(found.column("key").to_numpy(), sets, num, den) if len(sets) > 1 else []
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    edges = tasks.join(sets, "key").groupBy("pivot", "a", "b").applyInArrow(compare, "u bigint, v bigint")
    linked = components(edges)

    classes = sketched.where("n > 0").groupBy("key").agg(F.min("id").alias("least_id"))
    rooted = classes.join(linked.select(F.col("u").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("key", "component_id")
    return (
        sketched.select("id", "n", "key").join(named, "key", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The document with each component's own id, once. Rows without an id stay."""
    kept = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    first = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("_kept"), "left_semi").dropDuplicates([id_col])
    return first.unionByName(docs.where(F.col(id_col).isNull()))
