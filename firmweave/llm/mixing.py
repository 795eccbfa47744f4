"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times it should be taken. Rates are as near as possible to one, in relative
entropy weighted by size, such that each source's words meet its target, no rate passes ``most``, and the word-weighted mean of
each ``keep`` column stays what it was in its source. The dual of that problem is convex, its solution an
exponential tilt: rate = min(most, exp(dual value of the source + dual values x columns)).

``match`` columns tilt documents so that sources get alike: the word-weighted mean of each comes near its mean over all words. They are
counted in standard deviations, held to ``FAR`` of them, and a source's mean is asked to move by ``SHIFT`` at most. What is asked may be
out of reach (a source of long texts only), so it is soft: half of ``EASE`` times the squared dual values is added to the dual, and a
mean ends ``EASE`` times its dual value from what was asked. Words are never traded for it. With them the entropy is that of ``most``
places a document has, each taken or not, so the limit is part of a smooth curve: rate = most / (1 + (most - 1) exp(-tilt)).

1. Words are counted, once; what follows reads narrow rows. Documents alike in source and columns have one rate, so they
   are summed up to cells first, which keeps all that the dual needs.
2. Newton iterations: each sums words, gradient and Hessian of all sources over the cells, in Spark, and solves one small
   system for each source in the workers. Steps are held to a trust radius, which shrinks where the gap doesn't (with ``match``, a
   step is cut where the dual grows). Only the largest gap reaches the driver. With ``match`` a source whose target is its limit takes
   all documents ``most`` times: nothing else meets it.
3. Rates become copies. Documents of one source and size form a cell (one with very many rows is cut); from the largest size to the
   smallest, a cell takes as many additional copies as bring the words taken nearest to those wanted so far. What is left over is
   carried on, so a source ends about half its smallest document off its target. Within a cell a hash of id and
   text, divided by the rate's fraction, says which documents get them: reruns agree.

A task holds at most ``CELL_ROWS`` documents in 3, and one source's different sizes; the join of rates salts hot sources.

Edge cases: a null text has no words; a null source is a source of its own, last in order; repeated rows are documents of their
own; a source without words has the target 0; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmweave.operators.ranking import ordered_position
from firmweave.session import lookup_join, staged

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1 << 24  # rates are multiples of 1 / UNIT, so that sums don't depend on their order
CELL_ROWS = 100_000
ROUNDS, GAP = 80, 1e-10
EASE, SHIFT, FAR = 0.1, 0.5, 3.0


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shape(text_col: str = "text") -> dict[str, Column]:
    """Columns for ``match``, in steps: binary logarithm of a text's length, its characters a word, its bytes a character."""
    text = F.col(text_col).cast("string")
    step = lambda c, n: F.round(c * n) / n
    return {
        "length": step(F.log2(F.length(text) + 1.0), 4),
        "word": F.least(step(F.try_divide(F.length(text), words_in(text)), 4), F.lit(32.0)),
        "bytes": step(F.try_divide(F.octet_length(text), F.length(text)), 32),
    }


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Mapping[str, Column] | None = None) -> DataFrame:
    """``id``, ``size``, ``source``, ``grp`` (the source as a key in its order, null last), ``key`` (names the row), ``z`` (columns to keep)."""
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    size = words_in(text)
    z = F.array(*[c.cast("double") for c in (keep or {}).values()]).cast("array<double>")
    return docs.select(
        F.col(id_col).alias("id"), size.alias("size"), source.alias("source"), F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("grp"),
        F.xxhash64(F.col(id_col).cast("string"), text, source).alias("key"), z.alias("z"),
    )


def repeating_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to ``grp``, ``words``: the share of all words by the weights that repeat in order of ``grp``, at most ``most`` times a source's own.

    What a source can't take is reshared by weight among the others until none is above its limit.
    """
    placed = staged(ordered_position(staged(sources), "grp"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    placed = placed.select(*sources.columns, weight.alias("_weight"), (F.col("words") * most).alias("_limit"))
    level, full = 0.0, -1
    while True:
        over = F.col("_limit") <= F.col("_weight") * level
        total, taken, left, n = placed.agg(
            F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("_limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0.0)), F.count_if(over),
        ).first()
        if n == full or not left:
            break
        level, full = max(level, (share * total - taken) / left), n
    target = F.col("_limit") if not left else F.least("_limit", F.col("_weight") * level)
    return placed.withColumn("target", target).drop("_weight", "_limit")


def dual(cells: DataFrame, targets: DataFrame, tilts: int, most: float) -> DataFrame:
    """``grp``, ``lam``: the dual values of each source with words and a target above 0, given cells (grp, z, words) and targets (grp, words, target)."""
    size, top = tilts + 1, float(np.log(most))
    means = cells.where("words > 0").groupBy("grp").agg(*[F.sum(F.col("words") * F.col("z")[i]).alias(f"m{i}") for i in range(tilts)], F.count("*").alias("_n"))
    wanted = targets.where("words > 0 and target > 0").join(means, "grp")
    aims = F.array(F.col("target"), *[F.col("target") * F.col(f"m{i}") / F.col("words") for i in range(tilts)])
    zero = F.array(*[F.lit(0.0)] * size)
    state = staged(wanted.select("grp", aims.alias("aims"), zero.alias("lam"), F.lit(1.0).alias("radius"), F.lit(float("inf")).alias("gap")))
    x = [F.lit(1.0), *[F.col("z")[i] for i in range(tilts)]]
    tilt = sum((F.col("lam")[i] * x[i] for i in range(size)), F.lit(0.0))
    e = F.exp(F.least(F.col("_tilt"), F.lit(600.0)))
    rate, slope = F.least(e, F.lit(most)), F.when(F.col("_tilt") <= top + 1e-9, e).otherwise(0.0)
    sums = [F.sum(F.col("words") * rate * c) for c in x] + [F.sum(F.col("words") * slope * x[i] * x[j]) for i in range(size) for j in range(i, size)]
    reach = F.array(*[F.max(F.abs(c)) for c in x])
    schema = "grp string, aims array<double>, lam array<double>, radius double, gap double"

    def step(frames):
        for f in frames:
            out = [_newton(np.array(a), np.array(v), r, gap, np.array(s), np.array(m), low - top) for a, v, r, gap, s, m, low in
                   zip(f.aims, f.lam, f.radius, f.gap, f.sums, f.reach, f.low)]
            yield pd.DataFrame({"grp": f.grp, "aims": f.aims, "lam": [o[0].tolist() for o in out], "radius": [o[1] for o in out], "gap": [o[2] for o in out]})

    for _ in range(ROUNDS):
        at = lookup_join(cells.where("words > 0"), state.select("grp", "lam"), ["grp"], ["z", "words"]).where("lam is not null").withColumn("_tilt", tilt)
        found = at.groupBy("grp").agg(F.array(*sums).alias("sums"), reach.alias("reach"), F.min("_tilt").alias("low"))
        state = staged(state.join(found, "grp").mapInPandas(step, schema))
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= GAP:
            return state.select("grp", "lam")
    raise ValueError(f"targets aren't met within {worst:.2g} of their size after {ROUNDS} rounds; can the limit of {most} copies meet them?")


def _newton(aims: np.ndarray, lam: np.ndarray, radius: float, before: float, sums: np.ndarray, reach: np.ndarray, over: float) -> tuple[np.ndarray, float, float]:
    """The next dual values, trust radius and gap of one source. ``over``: how far the least tilt lies above where rates stop growing."""
    k = len(aims)
    miss = sums[:k] - aims
    gap = float(np.max(np.abs(miss) / (aims[0] * np.maximum(reach, 1e-300))))
    if gap <= GAP:
        return lam, radius, gap
    if over > 0:  # all rates are at their limit: go back to where they reach it, which changes none
        return lam - np.eye(k)[0] * over, radius, gap
    radius = radius / 2 if gap > before else min(1.0, radius * 1.5)
    curve = np.zeros((k, k))
    curve[np.triu_indices(k)] = sums[k:]
    curve = curve + np.triu(curve, 1).T + np.diag(1e-12 * aims[0] * reach**2)
    move = -np.linalg.lstsq(curve, miss, rcond=None)[0]
    most = float(np.abs(move) @ reach)
    return lam + move * min(1.0, radius / most if most else 1.0), radius, gap


def standardized(cells: DataFrame, hard: int, soft: int) -> Column:
    """``z`` with its last ``soft`` columns in standard deviations from the mean of all words in ``cells``; 0 for null."""
    moments = []
    for i in range(hard, hard + soft):
        z, n = F.col("z")[i], F.when(F.col("z")[i].isNotNull(), F.col("words"))
        moments.append(F.struct(F.sum(n).alias("n"), F.try_divide(F.sum(n * z), F.sum(n)).alias("mean"), F.try_divide(F.sum(n * z * z), F.sum(n)).alias("square")))
    out = [F.col("z")[i] for i in range(hard)]
    for i, m in enumerate(cells.agg(*moments).first(), hard):
        spread = max(m.square - m.mean**2, 0.0) ** 0.5 if m.n else 0.0
        vary = spread > 1e-6 * max(1.0, abs(m.mean or 0.0))  # else it says nothing
        scaled = F.greatest(F.least((F.col("z")[i] - m.mean) / spread, F.lit(FAR)), F.lit(-FAR)) if vary else F.lit(0.0)
        out.append(F.coalesce(scaled, F.lit(0.0)))
    return F.array(*out)


def match_dual(cells: DataFrame, targets: DataFrame, hard: int, soft: int, most: float) -> DataFrame:
    """``grp``, ``lam``: dual values as of ``dual``, but of the smooth limit, with ``hard`` columns to keep and then ``soft`` standardized ones to match.

    Only sources with a target above 0 and below their limit.
    """
    tilts = hard + soft
    size, off = tilts + 1, float(np.log(most - 1))
    means = cells.where("words > 0").groupBy("grp").agg(*[F.sum(F.col("words") * F.col("z")[i]).alias(f"m{i}") for i in range(tilts)])
    wanted = targets.where((F.col("words") > 0) & (F.col("target") > 0) & ~full(most)).join(means, "grp")
    mean = [F.col(f"m{i}") / F.col("words") for i in range(tilts)]
    held = [F.greatest(F.least(-m, F.lit(SHIFT)), F.lit(-SHIFT)) * F.col("target") for m in mean[hard:]]
    aims = F.array(F.col("target"), *[F.lit(0.0)] * hard, *held)
    odds = F.log(F.col("target") / (F.col("words") * most - F.col("target")))
    lam = F.array(odds + off, *[F.lit(0.0)] * tilts)
    state = staged(wanted.select(
        "grp", F.array(*mean).cast("array<double>").alias("mean"), aims.alias("aims"), lam.alias("lam"), lam.alias("base"),
        F.array(*[F.lit(0.0)] * size).alias("move"), F.lit(float("inf")).alias("value"), F.lit(float("inf")).alias("gap"),
    ))
    x = [F.lit(1.0), *[F.col("z")[i] - F.col("mean")[i] for i in range(tilts)]]
    tilt = sum((F.col("lam")[i] * x[i] for i in range(size)), F.lit(-off))
    t = F.least(F.greatest(F.col("_tilt"), F.lit(-600.0)), F.lit(600.0))
    taken = 1 / (1 + F.exp(-t))
    rate, slope, area = most * taken, most * taken * (1 - taken), most * (F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t))))
    sums = [F.sum(F.col("words") * rate * c) for c in x] + [F.sum(F.col("words") * slope * x[i] * x[j]) for i in range(size) for j in range(i, size)]
    reach = F.array(*[F.max(F.abs(c)) for c in x])
    ease = np.array([0.0] * (1 + hard) + [EASE] * soft)
    columns = ["lam", "base", "move", "value", "gap"]

    def step(frames):
        for f in frames:
            out = [_damped(*(np.array(v) for v in vectors), *scalars, ease) for *vectors, scalars in
                   zip(f.aims, f.lam, f.base, f.move, f.sums, f.reach, zip(f.area, f.value))]
            yield pd.DataFrame({"grp": f.grp, "mean": f["mean"], "aims": f.aims} | {c: [o[i] for o in out] for i, c in enumerate(columns)})

    for _ in range(ROUNDS):
        at = lookup_join(cells.where("words > 0"), state.select("grp", "lam", "mean"), ["grp"], ["z", "words"]).where("lam is not null").withColumn("_tilt", tilt)
        found = at.groupBy("grp").agg(F.array(*sums).alias("sums"), reach.alias("reach"), F.sum(F.col("words") * area).alias("area"))
        state = staged(state.join(found, "grp").mapInPandas(step, state.schema))
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= GAP:
            shift = F.aggregate(F.zip_with("mean", F.slice("lam", 2, max(1, tilts)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            found = F.concat(F.array(F.col("lam")[0] - shift), F.slice("lam", 2, max(1, tilts)))
            # Last digits depend on the order of sums.
            return state.select("grp", F.transform(found, lambda v: F.rint(v * (1 << 30)) / (1 << 30)).alias("lam"))
    raise ValueError(f"targets aren't met within {worst:.2g} of their size after {ROUNDS} rounds; can the columns to keep be kept?")


def _damped(
    aims: np.ndarray, lam: np.ndarray, base: np.ndarray, move: np.ndarray, sums: np.ndarray, reach: np.ndarray, area: float, before: float, ease: np.ndarray,
) -> tuple[list[float], list[float], list[float], float, float]:
    """The next dual values, those they start from, the step between, the dual there, and the gap at ``lam``. A step that raises the dual is cut to a quarter."""
    k = len(aims)
    miss = sums[:k] - aims + ease * aims[0] * lam
    gap = float(np.max(np.abs(miss) / (aims[0] * np.maximum(reach, 1e-3))))
    if gap <= GAP:
        return lam.tolist(), base.tolist(), move.tolist(), before, gap
    value = float(area - aims @ lam + aims[0] * (ease @ lam**2) / 2)
    if value > before + 1e-9 * abs(before):
        move = move / 4
        return (base + move).tolist(), base.tolist(), move.tolist(), before, gap
    curve = np.zeros((k, k))
    curve[np.triu_indices(k)] = sums[k:]
    curve = curve + np.triu(curve, 1).T + np.diag(1e-12 * aims[0] * reach**2 + ease * aims[0])
    move = -np.linalg.lstsq(curve, miss, rcond=None)[0]
    move = move * min(1.0, 3 / max(float(np.abs(move) @ reach), 1e-300))
    return (lam + move).tolist(), lam.tolist(), move.tolist(), value, gap


def full(most: float) -> Column:
    """Is the target of a source its limit?"""
    return F.col("target") >= F.col("words") * most * (1 - 1e-12)


def _carry(slots: pa.Table) -> pa.Table:
    """How many of each slot's documents get one more copy, from the largest size on."""
    size, salt, n, wanted = (slots.column(c).to_numpy() for c in ("size", "salt", "n", "part"))
    out, left = np.zeros(len(size), dtype=np.int64), 0.0
    for i in np.lexsort((salt, -size)):
        aim = wanted[i] / UNIT * size[i] + left
        out[i] = min(max(int(np.floor(aim / size[i] + 0.5)), 0), n[i])
        left = aim - out[i] * size[i]
    return pa.table({"grp": slots.column("grp"), "size": size, "salt": salt, "k": out})


def copies(rated: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``copies`` to rows with ``grp``, ``size``, ``key``, ``rate``."""
    units = F.round(F.col("rate") * UNIT).cast("bigint")
    split = staged(rated.withColumn("whole", F.floor(units / UNIT).cast("bigint")).withColumn("part", units % UNIT))
    cut = (F.col("part") > 0) & (F.col("size") > 0)
    large = split.where(cut).groupBy("grp", "size").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("pieces")).where("pieces > 1")
    salted = lookup_join(split.where(cut), staged(large), ["grp", "size"], ["key"])
    salted = staged(salted.withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces"))
    slots = salted.groupBy("grp", "size", "salt").agg(F.count("*").alias("n"), F.sum("part").alias("part"))
    given = slots.groupBy("grp").applyInArrow(_carry, "grp string, size bigint, salt int, k bigint")
    turn = F.row_number().over(W.partitionBy("grp", "size", "salt").orderBy(F.pmod("key", F.lit(1 << 52)) / F.col("part"), "key"))
    more = salted.join(given, ["grp", "size", "salt"]).withColumn("turn", turn)
    kept = [*split.columns]
    return (
        more.select(*kept, (F.col("whole") + (F.col("turn") <= F.col("k")).cast("bigint")).alias("copies"))
        .union(split.where(~cut).select(*kept, F.col("whole").alias("copies"))).drop("whole", "part")
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
    most: float = 2.0, keep: Mapping[str, Column] | None = None, match: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per document: its id, ``size``, ``source``, ``source_size``, ``target`` of its source, ``rate``, ``copies``."""
    hard, soft = len(keep or {}), len(match or {})
    rows = staged(sized(docs, id_col, text_col, source_col, dict(enumerate([*(keep or {}).values(), *(match or {}).values()]))))
    if soft:
        rows = staged(rows.withColumn("z", standardized(rows.withColumnRenamed("size", "words"), hard, soft)))
    cells = staged(rows.groupBy("grp", "z").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    targets = staged(repeating_targets(cells.groupBy("grp").agg(F.sum("words").alias("words")), weights, share, most))
    narrow = cells.select("grp", "z", "words")
    solved = match_dual(narrow, targets, hard, soft, most) if soft else dual(narrow, targets, hard, most)
    known = staged(targets.join(solved, "grp", "left"))
    placed = lookup_join(rows, known, ["grp"], ["key"])
    tilt = F.aggregate(F.zip_with("z", F.slice("lam", 2, max(1, hard + soft)), lambda a, b: a * b), F.col("lam")[0], lambda a, b: a + b)
    tilt = F.least(tilt, F.lit(600.0))
    if soft:
        rate = F.when(F.col("lam").isNotNull(), most / (1 + (most - 1) * F.exp(-F.greatest(tilt, F.lit(-600.0)))))
        rate = F.coalesce(rate, F.when((F.col("target") > 0) & full(most), F.lit(float(most))), F.lit(0.0))
    else:
        rate = F.when(F.col("lam").isNull(), 0.0).otherwise(F.least(F.exp(tilt), F.lit(float(most))))
    done = copies(placed.withColumn("rate", rate))
    return done.select(F.col("id").alias(id_col), "size", "source", F.col("words").alias("source_size"), "target", "rate", "copies")
