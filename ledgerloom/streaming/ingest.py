"""Statements that keep arriving: the import, run for each new set of files."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.rules import Rule
from ledgerloom.plans.imports import import_rows, require_accounts
from ledgerloom.sources.layouts import Layout
from ledgerloom.sources.shared import LISTED, folders
from ledgerloom.sources.statements import csv_options, csv_schema, locate, number_rows, place_rows
from ledgerloom.sources.store import Store


def stream_statements(
    store: Store,
    folder: str,
    layout: Layout,
    account_of: Callable[[Column], Column],
    checkpoint: str,
    rules: Iterable[Rule] = (),
    multi_line: bool = True,
    available_now: bool = True,
    by_folder: bool = False,
    files_at_once: int = LISTED,
) -> StreamingQuery:
    """Import every statement file that appears under `folder`, each once.

    `account_of` turns the path of a file into its account. Rows are appended with insert-or-ignore and
    statements are registered under an id made from the batch, so a batch that is run again after a failure
    adds nothing twice. No state is kept and a late file is simply appended. `checkpoint` must be shared. A batch has
    `files_at_once` files at most.

    Spark lists all files of a stream on the driver. `by_folder`, for what is available now, makes a stream of each
    folder that the wildcards above the last level of `folder` stand for, one after the other, each with a checkpoint
    of its own below `checkpoint`. The last one is returned, the others have ended.
    """
    rules = list(rules)
    if by_folder:
        if not available_now:
            raise ValueError("Streams by folder end, and so take only what is available now.")
        query = None
        for own in folders(store.spark, folder):
            if query:
                query.awaitTermination()
            place = f"{checkpoint}/{sha256(own.encode()).hexdigest()}"
            query = stream_statements(store, own, layout, account_of, place, rules, multi_line, files_at_once=files_at_once)
        return query

    spark = store.spark
    cells = locate(spark.readStream.schema(csv_schema(layout)).options(**csv_options(multi_line)).option("maxFilesPerTrigger", files_at_once).csv(folder))

    def import_batch(batch: DataFrame, epoch: int) -> None:
        blocks = not multi_line
        raw = place_rows(number_rows(batch, blocks), layout, blocks, staged=True)
        named = raw.files.withColumn("account_name", account_of(F.col("path")))
        require_accounts(store, named)
        import_rows(store, [(layout, raw, named)], f"{checkpoint}#{epoch}", datetime.now(), rules)

    query = cells.writeStream.foreachBatch(import_batch).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start() if available_now else query.start()
