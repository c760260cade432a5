"""Mixing sources to target weights with the cube method: balanced samples of fixed inclusion probability."""

from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import BLANKS, count_rows_up_to, global_rank
from ledgerloom.sources.shared import stage

#: The sources, in order, weigh these in turn.
WEIGHTS = (1, 2, 3)
#: No source is taken more often than this.
MOST = 3
#: Units that one task balances together; a larger source is cut into parts.
BLOCK = 4096
#: Units kept for the landing, besides those that the flight leaves.
LANDING = 12
#: Up to so many sources (a row of a few numbers each) are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
_EPSILON = 1e-9


def size_of(text: Column) -> Column:
    """The number of words of a text, 0 without a text."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANKS.replace("[", "[^"))), F.lit(0)).cast("bigint")


def targets(units: DataFrame) -> DataFrame:
    """One row for each source: `rank`, `weight`, `n_units`, `source_size`, `target`.

    The total of all sizes is shared by weight. A share above three times its source's size is cut to that, and the
    rest is shared anew among the others until none is above. The driver sees one level per round of that, no
    source. Sources are ordered by code point, null last.
    """
    sums = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_units")
    )
    ranked = stage(
        global_rank(sums, F.col("source").asc_nulls_last()).withColumn(
            "weight",
            F.element_at(F.lit(list(WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double"),
        ),
        "mix-sources",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    limit = F.lit(float(MOST)) * F.col("source_size")
    while level != before:
        above = F.col("weight") * F.lit(level) > limit if before is not None else F.lit(False)
        cut, weight = ranked.agg(
            F.sum(F.when(above, limit).otherwise(F.lit(0.0))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        before = level
        level = max(level, (total - (cut or 0.0)) / weight) if weight else level
        if not total:
            break
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), limit).cast("double"))


def _flight(sizes: list[float], counts: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """Move inclusion probabilities along the null space of the two totals until at most two are fractional.

    Three fractional units are held at a time. Their sizes and counts are two rows; a direction orthogonal to both
    changes neither total. One of the two ways along it, until a probability reaches 0 or 1, is drawn so that each
    probability is kept in expectation; the unit that is decided makes room for the next.
    """
    held: list[int] = []
    waiting = iter(range(len(chances)))
    while True:
        while len(held) < 3:
            at = next(waiting, None)
            if at is None:
                break
            if _EPSILON < chances[at] < 1 - _EPSILON:
                held.append(at)
            else:
                chances[at] = round(chances[at])
        if len(held) < 2:
            return chances
        s, c = [sizes[i] for i in held], [counts[i] for i in held]
        if len(held) == 3:
            way = [s[1] * c[2] - s[2] * c[1], s[2] * c[0] - s[0] * c[2], s[0] * c[1] - s[1] * c[0]]
            if not any(way):  # The rows depend on each other: two of the units balance alone.
                way = [c[1], -c[0], 0.0]
        elif s[0] * c[1] == s[1] * c[0]:
            way = [c[1], -c[0]]
        else:
            return chances
        up = min(((1 - chances[i]) if w > 0 else chances[i]) / abs(w) for i, w in zip(held, way) if w)
        down = min((chances[i] if w > 0 else (1 - chances[i])) / abs(w) for i, w in zip(held, way) if w)
        step = up if rng.random() * (up + down) < down else -down
        left = []
        for i, w in zip(held, way):
            chances[i] += step * w
            if _EPSILON < chances[i] < 1 - _EPSILON:
                left.append(i)
            else:
                chances[i] = float(round(chances[i]))
        held = left


def _reserve(sizes: list[float], chances: list[float]) -> list[int]:
    """Undecided units to be kept for the landing: the largest, and sizes near a half, a quarter, an eighth ... of it."""
    open_units = [i for i, p in enumerate(chances) if _EPSILON < p < 1 - _EPSILON]
    ranked = sorted(open_units, key=lambda i: (sizes[i], i))
    values = [sizes[i] for i in ranked]
    chosen: dict[int, None] = {}
    for halving in range(LANDING + 1):
        at = bisect.bisect_left(values, values[-1] / 2**halving) if values else 0
        while at < len(ranked) and ranked[at] in chosen:
            at += 1
        if at < len(ranked):
            chosen[ranked[at]] = None
    return list(chosen)


def _land(sizes: list[float], counts: list[float], chances: list[float]) -> list[float]:
    """Decide the last units: of all outcomes, the one whose totals of sizes, then counts, are nearest."""
    left = [i for i, p in enumerate(chances) if _EPSILON < p < 1 - _EPSILON]
    if left:
        outcomes = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1
        moved = outcomes - np.array([chances[i] for i in left])
        off_size = np.abs(moved @ np.array([sizes[i] for i in left]))
        off_count = np.abs(moved @ np.array([counts[i] for i in left]))
        largest, most = max(1.0, *(sizes[i] for i in left)), max(1.0, *(counts[i] for i in left))
        best = int(np.argmin(off_size / largest + 0.001 * off_count / most))
        for i, taken in zip(left, outcomes[best].tolist()):
            chances[i] = float(taken)
    return chances


def _balanced(last: bool):
    def run(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, [("doc_id", "ascending"), ("size", "ascending")]))
        part = block["part"][0].as_py()
        rng = random.Random(zlib.crc32(f"{block['rank'][0]}:{part}:{len(block)}".encode()))
        counts = [float(n) for n in block["n"].to_pylist()]
        sizes = [s * n for s, n in zip(block["size"].to_pylist(), counts)]
        chances = block["chance"].to_pylist()
        kept = _reserve(sizes, chances) if part == 0 else []
        grounded = set(kept)
        flying = [i for i in range(len(chances)) if i not in grounded]
        flown = _flight([sizes[i] for i in flying], [counts[i] for i in flying], [chances[i] for i in flying], rng)
        for i, chance in zip(flying, flown):
            chances[i] = chance
        if last:
            chances = _land(sizes, counts, chances)
        return block.set_column(block.schema.get_field_index("chance"), "chance", pa.array(chances, pa.float64()))

    return run


def mix(df: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each distinct (doc_id, source, size) of the input: `n` such rows, and how many `copies` of each the
    mix takes; with `source_size` and `target` of the source.

    Each source's ratio of target to size is split into whole copies, which every row gets, and a chance of one more.
    The cube method decides those: a sample that keeps the chances, the source's words and its rows until two units
    are undecided. Sources are balanced in parts of some thousand units, the parts' undecided units together, and so
    on until one part is left. A dozen units of graded sizes are kept out of the flight; with the last two undecided
    ones they are the landing problem, which is solved by trying all outcomes. Draws are seeded by source and part,
    so reruns agree.

    Rows that agree in id, source and size are one unit and get the same copies. A null source is a source of its
    own; null ids are units like others; a null size is 0. A source of size 0 has the target 0, and empty texts are
    balanced by their number. An empty input gives no rows. Other columns are not read.
    """
    units = stage(
        df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("n")),
        "mix-units",
    )
    by_source = stage(targets(units), "mix-targets")
    few = count_rows_up_to(by_source, BROADCAST_SOURCES) <= BROADCAST_SOURCES
    keyed = F.broadcast(by_source) if few else by_source
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(_EPSILON))
    rows = (
        units.join(keyed.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source", "weight")
        .withColumn("whole", whole.cast("bigint"))
        .withColumn("chance", F.greatest(ratio - whole, F.lit(0.0)))
        .withColumn("_parts", F.ceil(F.col("n_units") / BLOCK))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.col("_parts")))
        .drop("n_units")
    )
    fractional = (F.col("chance") > _EPSILON) & (F.col("chance") < 1 - _EPSILON)
    decided = []
    parts = rows.agg(F.max("_parts")).first()[0]
    while parts:
        # The last round has one part for each source; its parts also land.
        flown = stage(
            rows.where(fractional)
            .groupBy("rank", "part")
            .applyInArrow(_balanced(parts == 1), T.StructType(rows.schema.fields)),
            "mix-flight",
        )
        decided += [rows.where(~fractional), flown] if parts == 1 else [rows.where(~fractional)]
        if parts == 1:
            break
        rows = flown.withColumn("_parts", F.ceil(F.col("_parts") * 2 / BLOCK)).withColumn(
            "part", F.pmod("part", F.col("_parts"))
        )
        parts = -(-parts * 2 // BLOCK)
    out = decided[0] if decided else rows
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select(
        "doc_id", "source", "size", "n", "source_size", "target",
        (F.col("whole") + F.round("chance").cast("bigint")).alias("copies"),
    )


def mixed(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of the mix: each input row as often as the mix takes it, with the input's columns."""
    names = [F.col(f"`{name}`") for name in df.columns]
    plan = mix(df, size_of(F.col(text))).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.col("copies").alias("_copies"),
    )
    rows = df.select(
        F.struct(*names).alias("_row"), F.col("doc_id").alias("_i"), F.col("source").alias("_s"),
        size_of(F.col(text)).alias("_n"),
    )
    return (
        rows.join(
            plan,
            F.col("_i").eqNullSafe(F.col("_id"))
            & F.col("_s").eqNullSafe(F.col("_source"))
            & (F.col("_n") == F.col("_size")),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        .select("_row.*")
    )
