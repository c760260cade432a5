"""Reading statement CSV files: every row once, as text, with its file and its place in the file."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.cleaning import null_if_na
from ledgerloom.operators.lookup import HOT_ROWS
from ledgerloom.sources.layouts import Layout
from ledgerloom.sources.shared import in_parts, shared_folder, stage

RAW_LINE = "_raw_line"


# Larger files are cut into blocks where their content allows it; smaller ones are read whole.
LARGE_FILE = 64 * 1024 * 1024
# A quoted cell that is still open after so many lines makes the row a misfit, shown by these lines.
RECORD_LINES = 1000
# Bytes that opening a file is worth when files are given to tasks.
OPEN_COST = 128 * 1024


@dataclass(frozen=True)
class RawStatements:
    """Data rows of the files that fit the layout, and the files that do not.

    `rows` has the raw columns, `_src_file`, `_row` (ascending in file order, unique per file) and
    `_raw_line`, filled only where the row has too few or too many cells. `files` has the `path` of every
    file with at least one line. `hot_rows` is the size from which one statement is spread over several
    tasks; None when no file is large enough to need it.
    """

    rows: DataFrame
    rejected_files: DataFrame
    files: DataFrame
    hot_rows: int | None = HOT_ROWS


class LayoutMismatch(ValueError):
    """A file whose columns do not fit its layout."""


def csv_options(multi_line: bool) -> dict[str, str]:
    return {
        "header": "false",
        "multiLine": str(multi_line).lower(),
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": RAW_LINE,
        # The width check needs every cell, whatever is selected later.
        "columnPruning": "false",
    }


def csv_schema(layout: Layout) -> T.StructType:
    names = [*layout.raw_columns, RAW_LINE]
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def file_name(path: Column) -> Column:
    """The path as it was given: decoded, and without the scheme of local files."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "/")


def read_statements(
    spark: SparkSession,
    paths: list[str],
    layout: Layout,
    multi_line: bool | None = None,
    staged: bool = False,
    large_file: int = LARGE_FILE,
) -> RawStatements:
    """Read statement files of one layout.

    Ordinary files are read whole, each by one task. Large files are cut into blocks for many tasks, also where
    quoted cells run over line ends (`split_records`). `multi_line` forces whole files (True) or blocks of lines
    (False). `staged` writes the numbered rows to a shared folder first, so the files are parsed only once; it
    is implied by large files. Many files are then read in parts, so that the driver holds one part's list of files.
    """
    if not staged:
        numbered, cut = _numbered(spark, paths, layout, multi_line, large_file)
        raw = place_rows(numbered, layout, blocks=cut, staged=cut and multi_line is None)
        return raw if cut or multi_line is not None else replace(raw, hot_rows=None)
    return read_parts(spark, in_parts(spark, paths), layout, multi_line, large_file)


def read_parts(
    spark: SparkSession,
    parts: Iterable[list[str]],
    layout: Layout,
    multi_line: bool | None = None,
    large_file: int = LARGE_FILE,
) -> RawStatements:
    """`read_statements` for paths in parts, one part after the other; the numbered rows are written to a shared folder."""
    folder, any_cut = shared_folder(spark, "statement-rows"), False
    with _small_files(spark):
        for part in parts:
            numbered, cut = _numbered(spark, part, layout, multi_line, large_file)
            numbered.write.mode("append").parquet(folder)
            any_cut = any_cut or cut
    raw = place_rows(spark.read.schema(numbered.schema).parquet(folder), layout, blocks=True)
    return raw if any_cut or multi_line is not None else replace(raw, hot_rows=None)


def _numbered(
    spark: SparkSession, paths: list[str], layout: Layout, multi_line: bool | None, large_file: int
) -> tuple[DataFrame, bool]:
    """The rows with their places, and whether files were cut into blocks."""
    if multi_line is not None:
        return number_rows(locate(_cells(spark, paths, layout, multi_line)), blocks=not multi_line), not multi_line
    cells = _cells(spark, paths, layout, True)
    # Filters on file metadata choose files before any is opened.
    large = F.col("_metadata.file_size") > large_file
    if cells.where(large).isEmpty():
        return number_rows(locate(cells), blocks=False), False
    return number_rows(locate(cells.where(~large)), blocks=False).unionByName(
        split_records(spark.read.text(paths).where(large), layout)
    ), True


@contextmanager
def _small_files(spark: SparkSession) -> Iterator[None]:
    """Tasks take files by their size, not some thirty of whatever size."""
    cost, before = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(cost, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set(cost, before)


def _cells(spark: SparkSession, paths: list[str], layout: Layout, multi_line: bool) -> DataFrame:
    return spark.read.schema(csv_schema(layout)).options(**csv_options(multi_line)).csv(paths)


# A line that is complete up to a quoted cell which it opens and does not close. A quote within a cell that does
# not begin with one is a plain character.
_CLOSED_CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+),'
_OPENS = rf'^(?:{_CLOSED_CELL})*+"(?:[^"]++|"")*+$'
# The end of a quoted cell that an earlier line opened, up to the next delimiter.
_CLOSES = r'^(?:[^"]++|"")*+"[^,]*+'


def _line_states(lines: DataFrame) -> DataFrame:
    """Each line with its number in its block, and whether it begins inside a quoted cell if the block does not
    (`inside_0`) or does (`inside_1`); `after_0` and `after_1` say the same of its end.

    A line turns either state of its start into one of its end: it fixes the state, keeps it or swaps it. The state
    after a line is what the last fixing line left, swapped as often as lines since have swapped it.
    """
    value = F.col("value")
    rest = F.regexp_replace(value, _CLOSES, "")
    from_0 = value.rlike(_OPENS).cast("int")
    from_1 = F.when(~value.rlike(_CLOSES), 1).when(rest == "", 0).otherwise(F.substring(rest, 2, 1 << 30).rlike(_OPENS).cast("int"))
    in_block = Window.partitionBy("_src_file", "_block_start").orderBy("_read_order")
    states = (
        lines.select(
            "value", file_name(F.col("_metadata.file_path")).alias("_src_file"),
            F.col("_metadata.file_block_start").alias("_block_start"), F.monotonically_increasing_id().alias("_read_order"),
            from_0.alias("_from_0"), from_1.alias("_from_1"),
        )
        .withColumn("_at", F.row_number().over(in_block))
        .withColumn("_swaps", F.sum(F.when((F.col("_from_0") == 1) & (F.col("_from_1") == 0), 1).otherwise(0)).over(in_block))
        .withColumn(
            "_fixed",
            F.last(F.when(F.col("_from_0") == F.col("_from_1"), (F.col("_from_0") + F.col("_swaps")) % 2), True).over(in_block),
        )
    )
    for start in (0, 1):
        after = (F.coalesce("_fixed", F.lit(start)) + F.col("_swaps")) % 2
        states = states.withColumn(f"after_{start}", after).withColumn(
            f"inside_{start}", F.lag(f"after_{start}", 1, start).over(in_block)
        )
    return states.select(
        "_src_file", "_block_start", "_at", "value", "inside_0", "after_0", "inside_1", "after_1"
    )


def _block_states(states: DataFrame) -> DataFrame:
    """For each block of a file: whether it begins inside a quoted cell, and where the row began that goes on in it.

    The same reasoning as for lines, with a row for each block: no window holds more than one file's blocks.
    """
    ends = states.groupBy("_src_file", "_block_start").agg(
        *[F.max_by(f"after_{start}", "_at").alias(f"_end_{start}") for start in (0, 1)],
        *[F.max(F.when(F.col(f"inside_{start}") == 0, F.col("_at"))).alias(f"_last_{start}") for start in (0, 1)],
    )
    in_file = Window.partitionBy("_src_file").orderBy("_block_start")
    swaps = (F.col("_end_0") == 1) & (F.col("_end_1") == 0)
    fixed = F.when(F.col("_end_0") == F.col("_end_1"), (F.col("_end_0") + F.col("_swaps")) % 2)
    return (
        ends.withColumn("_swaps", F.sum(swaps.cast("int")).over(in_file))
        .withColumn("_fixed", F.last(fixed, True).over(in_file))
        .withColumn("_after", (F.coalesce("_fixed", F.lit(0)) + F.col("_swaps")) % 2)
        .withColumn("_start", F.lag("_after", 1, 0).over(in_file))
        .withColumn("_last", F.when(F.col("_start") == 0, F.col("_last_0")).otherwise(F.col("_last_1")))
        .withColumn("_nth_block", F.row_number().over(in_file))
        .withColumn("_began", F.when(F.col("_last").isNotNull(), F.struct("_block_start", "_last", "_nth_block")))
        .withColumn("_open", F.last("_began", True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)))
        .select("_src_file", "_block_start", "_start", "_open", (F.col("_nth_block") - F.col("_open._nth_block")).alias("_since"))
    )


def split_records(lines: DataFrame, layout: Layout) -> DataFrame:
    """The rows of files read as lines, by blocks: cells, `_src_file`, `_block_start`, `_line` in the block.

    A row begins at a line that is not inside a quoted cell, and belongs to the block that it begins in, however
    many lines and blocks it takes. Which lines those are follows from the parity of quotes: of each line, then of
    each block, then of all blocks before. A quote that opens a cell by mistake costs the rows up to the next quoted
    cell; how these are cut can differ from whole files, all others are the same. Line ends within cells become \\n.
    """
    states = stage(_line_states(lines), "statement-lines")
    placed = states.join(_block_states(states), ["_src_file", "_block_start"])
    in_block = Window.partitionBy("_src_file", "_block_start").orderBy("_at")
    inside, after = (
        F.when(F.col("_start") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1")) for name in ("inside", "after")
    )
    placed = placed.withColumn("_inside", inside).withColumn("_after", after).withColumn(
        "_first", F.last(F.when(F.col("_inside") == 0, F.col("_at")), True).over(in_block)
    )
    whole = placed.where("_inside = 0 and _after = 0").select("_src_file", "_block_start", "_at", F.col("value").alias("_record"), F.lit(False).alias("_long"))
    pieces = placed.where("_inside = 1 or _after = 1").select(
        "_src_file", F.struct("_block_start", "_at").alias("_place"), "value",
        F.when(F.col("_first").isNull(), F.col("_open._block_start")).otherwise(F.col("_block_start")).alias("_block_start"),
        F.coalesce("_first", "_open._last").alias("_of"),
        F.when(F.col("_first").isNull(), F.col("_since")).otherwise(0).alias("_since"),
    )
    # A row without end is cut where it is read and never gathered: by lines in a block, and by blocks.
    in_part = Window.partitionBy("_src_file", "_place._block_start", "_block_start", "_of").orderBy("_place")
    joined = (
        pieces.withColumn("_nth", F.row_number().over(in_part))
        .where((F.col("_nth") <= RECORD_LINES) & (F.col("_since") <= RECORD_LINES))
        .groupBy("_src_file", "_block_start", "_of")
        .agg(F.sort_array(F.collect_list(F.struct("_place", "value"))).alias("_lines"), F.max("_since").alias("_far"))
        .select(
            "_src_file", "_block_start", F.col("_of").alias("_at"),
            F.array_join(F.slice(F.transform("_lines", lambda line: line["value"]), 1, RECORD_LINES), "\n").alias("_record"),
            ((F.size("_lines") >= RECORD_LINES) | (F.col("_far") >= RECORD_LINES)).alias("_long"),
        )
    )
    records = whole.unionByName(joined).where(~F.col("_record").rlike(r"^[\x00-\x20]*$"))
    schema = ", ".join(f"`{field.name}` string" for field in csv_schema(layout))
    options = csv_options(True)
    parsed = F.from_csv(F.when(~F.col("_long"), F.col("_record")), schema, options)
    numbered = records.withColumn("_line", F.row_number().over(in_block)).withColumn("_cells", parsed)
    return numbered.select(
        *[F.col("_cells")[name].alias(name) for name in layout.raw_columns],
        F.coalesce(F.when(F.col("_long"), F.col("_record")), F.col("_cells")[RAW_LINE]).alias(RAW_LINE),
        "_src_file", "_block_start", "_line",
    )


def locate(cells: DataFrame) -> DataFrame:
    """Add where each row was read: its file and the start of its block. Lines of blanks are no rows."""
    # Reading by blocks drops them in the reader; whole files are read with them.
    others = [F.col(name).isNull() for name in cells.columns if name not in ("_c0", RAW_LINE)]
    blank = reduce(and_, others, F.coalesce("_c0", F.lit("")).rlike(r"^[\x00-\x20]*$"))
    cells = cells.where(~(blank & F.col(RAW_LINE).isNotNull()))
    # Spark refuses to read nothing but the malformed line, so it is tied to a cell.
    raw_line = F.when(F.col(RAW_LINE).isNotNull(), F.coalesce(F.col(RAW_LINE), F.col("_c0")))
    return cells.withColumn(RAW_LINE, raw_line).select(
        "*",
        file_name(F.col("_metadata.file_path")).alias("_src_file"),
        F.col("_metadata.file_block_start").alias("_block_start"),
    )


def number_rows(located: DataFrame, blocks: bool) -> DataFrame:
    """Add `_line`, the place of each row in its file, or in its block of the file.

    The window holds what one task has read, a file or a block, and never more.
    """
    part = ["_src_file", "_block_start"] if blocks else ["_src_file"]
    ordered = located.withColumn("_read_order", F.monotonically_increasing_id())
    in_part = Window.partitionBy(*part).orderBy("_read_order")
    return ordered.withColumn("_line", F.row_number().over(in_part)).drop("_read_order")


def place_rows(numbered: DataFrame, layout: Layout, blocks: bool, staged: bool = False) -> RawStatements:
    """Check the header line of each file and drop it together with the title lines."""
    if staged:
        numbered = stage(numbered, "statement-rows")
    header_line = layout.title_rows + 1
    is_header = (F.col("_block_start") == 0) & (F.col("_line") == header_line)
    rejected = numbered.where(is_header & F.col(RAW_LINE).isNotNull()).select(
        F.col("_src_file").alias("source_file"),
        F.lit(len(layout.columns)).alias("expected_columns"),
        F.col(RAW_LINE).alias("header_line"),
    )
    if blocks or staged:
        fitting = numbered.join(rejected, F.col("_src_file") == F.col("source_file"), "left_anti")
    else:
        misfit = F.max(F.when(is_header, F.col(RAW_LINE))).over(Window.partitionBy("_src_file"))
        fitting = numbered.withColumn("_misfit", misfit).where(F.col("_misfit").isNull())
    rows = (
        fitting.where((F.col("_block_start") > 0) | (F.col("_line") > header_line))
        # A row takes at least one byte, so block start plus line number rises through the file.
        .withColumn("_row", F.col("_block_start") + F.col("_line"))
        .select(
            *[null_if_na(F.col(name)).alias(name) for name in layout.raw_columns],
            "_src_file",
            "_row",
            RAW_LINE,
        )
    )
    files = numbered.select(F.col("_src_file").alias("path")).distinct()
    return RawStatements(rows, rejected, files)


def require_all_files(statements: RawStatements, layout: Layout) -> None:
    """Raise when a file does not fit the layout."""
    misfit = statements.rejected_files.limit(1).collect()
    if misfit:
        raise LayoutMismatch(
            f"{layout.name} has {len(layout.columns)} columns, but {misfit[0].source_file} starts with: "
            f"{misfit[0].header_line}"
        )
