"""Matching a column of misspelt names against a table of known names.

The cascade is exact, unique prefix, one close match, one substring match. Exact and prefix matches are
equi-joins. A name they do not settle first meets its neighbours in the order of spelling, forwards and backwards:
one with CLOSE_MATCHES close ones among them is ambiguous, whatever else there is. Only the others are compared with
all candidates, in blocks of bounded size; no pair is ever a row, each block reports its matches per name as counts
and one example.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cleaning import fold_name
from ledgerloom.functions.names import CLOSE_MATCHES, CloseNames, close_among
from ledgerloom.operators.lookup import fits
from ledgerloom.sources.shared import stage

# Up to this many candidates travel with the tasks; beyond it both sides are cut into blocks.
LOCAL_CANDIDATES = 50_000
# Names and candidates per block.
NAME_BLOCK = 5_000
CANDIDATE_BLOCK = 50_000
# Names that one task compares with all local candidates.
LOCAL_NAMES = 1_000
# Candidates before and after a name in the order of spelling that it meets first.
NEIGHBOURS = 4
# Names and candidates in order that one task goes through.
ORDERED_WORDS = 20_000

_FOUND = "folded string, n_close long, close string, n_held long, held string"


def resolve_names(
    names: DataFrame,
    column: str,
    candidates: DataFrame,
    candidate: str,
    local_candidates: int = LOCAL_CANDIDATES,
    name_block: int = NAME_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """One row per distinct name: `input, match, method, n_candidates`.

    `method` is exact, prefix, similar, substring, ambiguous or none; the last two have no match. Candidates
    that differ only in case, spaces and commas count as one, shown by the greatest spelling.
    """
    inputs = (
        names.select(F.col(column).alias("input"))
        .where(F.col("input").isNotNull())
        .distinct()
        .withColumn("folded", fold_name(F.col("input")))
    )
    known = stage(
        candidates.select(F.col(candidate).alias("name"))
        .where(F.col("name").isNotNull())
        .groupBy(fold_name(F.col("name")).alias("key"))
        .agg(F.max("name").alias("name")),
        "names-known",
    )
    prefixes = (
        known.select(
            F.explode(
                F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.substring("key", F.lit(1), n))
            ).alias("prefix"),
            "name",
        )
        .groupBy("prefix")
        .agg(F.count("*").alias("n_started"), F.min("name").alias("started"))
        .where(F.col("n_started") == 1)
        .select("prefix", "started")
    )
    settled = stage(
        inputs.join(known, inputs.folded == known.key, "left")
        .join(prefixes, inputs.folded == prefixes.prefix, "left")
        .select(
            "input",
            "folded",
            F.coalesce("name", "started").alias("match"),
            F.when(F.col("name").isNotNull(), "exact").when(F.col("started").isNotNull(), "prefix").alias("method"),
        ),
        "names-settled",
    )
    open_names = settled.where(F.col("method").isNull()).select("folded").distinct()
    crowded = []
    for spelling in (F.reverse, F.col):
        met = stage(_meet_neighbours(open_names, known, spelling), "names-met")
        crowded.append(met.where(F.col("n_close") == CLOSE_MATCHES))
        open_names = met.where(F.col("n_close") < CLOSE_MATCHES).select("folded")
    if fits(known, local_candidates):
        found = _compare_locally(open_names, [row.key for row in known.select("key").collect()])
    else:
        found = _compare_in_blocks(open_names, known, name_block, candidate_block)
    for rows in crowded:
        found = found.unionByName(rows, allowMissingColumns=True)

    decided = found.select(
        F.col("folded").alias("open"),
        F.when(F.col("n_close") == 1, "similar")
        .when(F.col("n_close") > 1, "ambiguous")
        .when(F.col("n_held") == 1, "substring")
        .when(F.col("n_held") > 1, "ambiguous")
        .otherwise("none")
        .alias("found_method"),
        F.when(F.col("n_close") > 0, F.least("n_close", F.lit(CLOSE_MATCHES)))
        .otherwise(F.col("n_held"))
        .alias("found_candidates"),
        F.when(F.col("n_close") == 1, F.col("close"))
        .when((F.col("n_close") == 0) & (F.col("n_held") == 1), F.col("held"))
        .alias("found_key"),
    )
    spelt = decided.join(known.select(F.col("key"), F.col("name").alias("found_name")), F.col("found_key") == F.col("key"), "left")
    return settled.join(spelt, (F.col("folded") == F.col("open")) & F.col("method").isNull(), "left").select(
        "input",
        F.coalesce("match", "found_name").alias("match"),
        F.coalesce("method", "found_method").alias("method"),
        F.when(F.col("method").isNotNull(), F.lit(1).cast("bigint"))
        .otherwise(F.col("found_candidates"))
        .alias("n_candidates"),
    )


def _meet_neighbours(open_names: DataFrame, known: DataFrame, spelling: Callable[[Column | str], Column]) -> DataFrame:
    """`folded`, `n_close`: how many of the candidates next to a name in the order of `spelling` are close to it.

    A name sees the candidates around it in its range of spellings and its batch of rows, so that no more is held.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, is_key = batch["word"].to_numpy(), batch["is_key"].to_numpy()
            keys, places = words[is_key], is_key.cumsum()
            rows = []
            for at in (~is_key).nonzero()[0]:
                around = keys[max(0, places[at] - NEIGHBOURS) : places[at] + NEIGHBOURS]
                rows.append((words[at], len(close_among(words[at], around))))
            yield pd.DataFrame(rows, columns=["folded", "n_close"])

    words = open_names.select(F.col("folded").alias("word"), F.lit(False).alias("is_key")).unionByName(
        known.select(F.col("key").alias("word"), F.lit(True).alias("is_key"))
    )
    parts = max(1, -(-words.count() // ORDERED_WORDS))
    ordered = words.withColumn("_order", spelling("word")).repartitionByRange(parts, "_order").sortWithinPartitions("_order")
    return ordered.select("word", "is_key").mapInPandas(meet, "folded string, n_close long")


def _search(queries: Iterator[str], index: CloseNames) -> pd.DataFrame:
    rows = []
    for query in queries:
        close = index.similar(query)
        # Names that hold the query are asked only if nothing is close, in this block or another.
        held = [] if close else index.containing(query)
        rows.append((query, len(close), max(close, default=None), len(held), max(held, default=None)))
    return pd.DataFrame(rows, columns=["folded", "n_close", "close", "n_held", "held"])


def _compare_locally(open_names: DataFrame, keys: list[str]) -> DataFrame:
    """Names in parts of LOCAL_NAMES, however few bytes they have, against all candidates."""
    parts = max(1, -(-open_names.count() // LOCAL_NAMES))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CloseNames(keys)
        for batch in batches:
            yield _search(batch["folded"], index)

    return open_names.repartition(parts, "folded").mapInPandas(search, _FOUND)


def _compare_in_blocks(
    open_names: DataFrame, known: DataFrame, name_block: int, candidate_block: int
) -> DataFrame:
    """Blocks of names meet blocks of candidates of a length that can match, one task per meeting.

    Bands double in length. A close match differs in length by less than a factor of two and a substring is
    never longer than its holder, so a name only meets candidates from one band below its own upwards.
    """

    def banded(df: DataFrame, key: str, band: str) -> DataFrame:
        return df.select(F.col(key), F.length(F.bin(F.length(key))).alias(band))

    def blocks(df: DataFrame, band: str, size: int) -> dict[int, int]:
        """Blocks per band; there are as many bands as the longest name has binary digits."""
        counted = df.groupBy(band).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
        return {row[band]: row.blocks for row in counted.collect()}

    names = banded(open_names, "folded", "name_band")
    keys = banded(known, "key", "key_band")
    name_blocks = blocks(names, "name_band", name_block)
    key_blocks = blocks(keys, "key_band", candidate_block)
    pairs = [
        (name_band, key_band, name_blocks[name_band], key_blocks[key_band])
        for name_band in name_blocks
        for key_band in key_blocks
        if key_band >= name_band - 1
    ]

    def meetings() -> DataFrame:
        """Bands that can match, with their numbers of blocks: bands squared at most."""
        schema = "name_band int, key_band int, name_blocks int, key_blocks int"
        return F.broadcast(open_names.sparkSession.createDataFrame(pairs, schema))

    def part(key: str, count: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    cell = ["name_band", "key_band", "name_part", "key_part"]
    left = (
        names.join(meetings(), "name_band")
        .withColumn("name_part", part("folded", "name_blocks"))
        .withColumn("key_part", every("key_blocks"))
        .select("folded", *cell)
    )
    right = (
        keys.join(meetings(), "key_band")
        .withColumn("key_part", part("key", "key_blocks"))
        .withColumn("name_part", every("name_blocks"))
        .select("key", *cell)
    )

    def search(some_names: pd.DataFrame, some_keys: pd.DataFrame) -> pd.DataFrame:
        return _search(some_names["folded"], CloseNames(list(some_keys["key"])))

    partial = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(search, _FOUND)
    counted = partial.groupBy("folded").agg(
        F.sum("n_close").alias("n_close"),
        F.max("close").alias("close"),
        F.sum("n_held").alias("n_held"),
        F.max("held").alias("held"),
    )
    return open_names.join(counted, "folded", "left").fillna(0, ["n_close", "n_held"])
