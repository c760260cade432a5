"""Exact duplicates by an extendible-hash index on shared files, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stage

#: The directory has at most 2 ** DEPTH slots, so it can be broadcast at any size of the corpus.
DEPTH = 16
#: Entries that a bucket of the index holds before it splits; in a large corpus, more: a quarter of the slots suffices.
CAPACITY = 1000
#: Bits of the filter for each key that occurs more than once, and the most bits that the filter can have.
BITS_PER_KEY = 16
MOST_BITS = 30
#: Fixed value: bits in one piece of a Spark bitmap.
PIECE = 15

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed. No text is the empty text."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def slot_of(key: Column, depth: int) -> Column:
    """The highest `depth` bits of a 64-bit key: a slot of a directory of that depth is a range of keys."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def repeated_filter(keys: DataFrame, repeated: int) -> tuple[DataFrame, int]:
    """A bitmap with the bit of every key that occurs more than once, in pieces, and the number of its bits as a power
    of 2. It grows with the number of those keys up to 2 ** MOST_BITS bits; beyond, it lets more of the others pass."""
    power = min(MOST_BITS, max(PIECE, math.ceil(math.log2(1 + repeated * BITS_PER_KEY))))
    bit = F.col("key").bitwiseAND(F.lit((1 << power) - 1))
    pieces = (
        keys.where("n > 1")
        .select(F.shiftright(bit, PIECE).alias("_piece"), bit.bitwiseAND(F.lit((1 << PIECE) - 1)).alias("_bit"))
        .groupBy("_piece")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )
    return pieces, power


def _in_filter(key: Column, power: int) -> Column:
    at = key.bitwiseAND(F.lit((1 << PIECE) - 1))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast((key & 32767) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def directory(keys: DataFrame, rows: int, capacity: int) -> tuple[DataFrame, int]:
    """The directory over the keys that occur more than once, and its depth: `slot`, `bucket`, `local_depth`, `pages`.

    A bucket that holds more than `capacity` entries splits by one more bit of the key, and where a bucket is as deep as
    the directory, the directory doubles. A bucket therefore ends at the smallest depth at which it fits; all doublings
    are read off one table, the entries of each slot of the deepest directory summed up for every depth. One key cannot
    be split: a bucket of one key, or at the last depth, goes on in overflow pages of `capacity` entries.
    """
    most = min(DEPTH, max(0, math.ceil(math.log2(max(rows, 1) / capacity)) + 3)) if rows > capacity else 0
    cells = keys.where("n > 1").groupBy(slot_of(F.col("key"), most).alias("cell")).agg(
        F.sum("n").alias("entries"), F.count(F.lit(1)).alias("held")
    )
    levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {most} - depth)")
    )
    sums = levels.groupBy("depth", "prefix").agg(F.sum("entries").alias("entries"), F.sum("held").alias("held"))
    fits = sums.where(f"entries <= {capacity} or held = 1 or depth = {most}").select(
        "depth", "prefix", F.ceil(F.col("entries") / capacity).alias("pages")
    )
    first = levels.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(
        F.min(F.struct("depth", "prefix", "pages")).alias("own")
    )
    slots = first.select(
        F.col("cell").alias("slot"),
        F.expr(f"shiftleft(own.prefix, {most} - own.depth)").alias("bucket"),
        F.col("own.depth").alias("local_depth"),
        F.col("own.pages").alias("pages"),
    )
    return slots, most


def exact_groups(
    docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64, capacity: int | None = None
) -> DataFrame:
    """For each row of `docs`: doc_id, keep_id (doc_id of the row of its group that stays), group_size, kept and
    text_sha256 (lower-case hex of the normalised text).

    Rows are a group when their texts are the same bytes after A-Z is lower-cased. A key is a 64-bit hash of the text;
    rows whose key no other row has are alone. The others become entries of an extendible-hash index: files in the
    shared folder, dealt out by the bucket that the directory names for a range of keys, and by overflow page. The
    owner of a bucket chains the different texts of a key, comparing their bytes; copies collapse before they move. Only
    texts that pass a filter of the repeated keys are moved at all. `hashed` can be any function to 64 bits; a poor one
    makes chains longer and changes no result.

    The largest doc_id stays, null being smaller than all; of rows that agree in it, repeated rows, one stays. Null is
    the empty text, and empty texts are a group like others. An empty table gives no rows. Further columns of `docs`
    are not read.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("key", hashed(F.col("text")))
    keys = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    repeated, entries = keys.where("n > 1").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    pieces, power = repeated_filter(keys, repeated)
    slots, depth = directory(keys, entries, capacity or max(CAPACITY, entries >> DEPTH - 2))
    slots = stage(slots, "directory")

    piece = F.shiftright(F.col("key").bitwiseAND(F.lit((1 << power) - 1)), PIECE)
    sifted = rows.join(F.broadcast(pieces), piece == F.col("_piece"), "left").select(
        "doc_id",
        "key",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.when(_in_filter(F.col("key"), power), F.col("text")).alias("text"),
    )
    # A row number that stays: it is written with the row.
    sifted = stage(sifted.withColumn("pos", F.monotonically_increasing_id()), "sifted")
    alone = sifted.where("text is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "digest",
    )
    # What the filter lets pass without need has a slot of its own kind.
    placed = sifted.where("text is not null").join(
        F.broadcast(slots), slot_of(F.col("key"), depth) == F.col("slot"), "left"
    )
    pages = F.coalesce("pages", F.lit(1))
    index = stage(
        placed.select(
            F.coalesce("bucket", slot_of(F.col("key"), depth)).alias("bucket"), F.pmod("pos", pages).alias("page"),
            pages.alias("pages"), "key", "text", "doc_id", "digest", "pos",
        ).repartition("bucket", "page"),
        "index",
    )
    heads = stage(
        index.groupBy("bucket", "key", "text")
        .agg(
            F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"),
            F.coalesce(F.max_by("pos", "doc_id"), F.max("pos")).alias("keep_pos"), F.max("pages").alias("pages"),
        ),
        "heads",
    )
    chains = stage(
        heads.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("links")).where("links > 1").select("bucket", "key"),
        "chains",
    )
    on_pages = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pages") - 1)).alias("page")
    of_head = ["group_size", "keep_id", "keep_pos"]
    of_row = ["key", "page", "doc_id", "digest", "pos"]
    # One text to a key: the key says which head. More: the bytes do.
    plain = heads.join(chains, ["bucket", "key"], "left_anti").select("key", on_pages, *of_head)
    grouped = index.select(*of_row).join(plain, ["key", "page"])
    if not chains.isEmpty():
        several = heads.join(chains, ["bucket", "key"], "left_semi").select("key", on_pages, *of_head, "text")
        linked = index.join(chains, ["bucket", "key"], "left_semi").select(*of_row, "text")
        grouped = grouped.unionByName(linked.join(several, ["key", "page", "text"]).drop("text"))
    return grouped.select(
        "doc_id", "keep_id", "group_size", (F.col("pos") == F.col("keep_pos")).alias("kept"), "digest"
    ).unionByName(alone).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` but for copies: of equal texts, the row with the largest doc_id. All columns are kept.

    Nulls, ties, empty texts and tables as in `exact_groups`; all rows without a text and with an empty one are one
    group. Of rows that agree in doc_id and normalised text, one stays.
    """
    found = stage(exact_groups(docs), "exact-groups").where("kept").select(
        F.col("doc_id").alias("_k"), F.col("text_sha256").alias("_s")
    )
    text = normalised(F.col("text")).cast("binary")
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"), F.col("doc_id").alias("_i"),
        F.sha2(text, 256).alias("_h"),
    )
    kept = rows.join(found, F.col("_i").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_s")), "left_semi")
    repeated = rows.groupBy("_i", "_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
    return (kept if repeated else kept.dropDuplicates(["_i", "_h"])).select("_row.*")


#: The same rows in DuckDB SQL.
ORACLE = f"""
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') as t from documents)
window same as (partition by t)"""
