"""Benchmark passages in documents, found with a positional inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import count_rows_up_to
from ledgerloom.sources.shared import stage

#: A window is so many words.
WINDOW = 10
#: Lists that are intersected for each window: those of its rarest terms.
PROBES = 3
#: A proximity match has the probes up to so many words from their places.
SLOP = 3
#: Terms of one pass over the documents: they travel to the tasks. More terms take more passes.
PASS_TERMS = 200_000
#: Tables of matches up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000

# Bytes of words: digits, letters and all beyond ASCII; A-Z become a-z, the others blanks.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text after lower-casing A-Z; none of a null text."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], length: int = WINDOW) -> list[list[bytes]]:
    """All runs of `length` words; of fewer words, but not none, the one run of all."""
    if not words:
        return []
    return [words[i : i + length] for i in range(max(1, len(words) - length + 1))]


_ITEM_WINDOWS = "item_id string, phrase string, size int"


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """One row for each item and distinct window of it: item_id as text, the window's words joined by a blank."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = windows_of(words_of(body), length)
                phrases = list(dict.fromkeys(b" ".join(w).decode() for w in found))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(phrases), pa.string()),
                        pa.array(phrases, pa.string()),
                        pa.array([len(found[0]) if found else 0] * len(phrases), pa.int32()),
                    ],
                    names=["item_id", "phrase", "size"],
                )

    rows = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, _ITEM_WINDOWS)


def _passes(spark: SparkSession, terms: DataFrame) -> Iterator[object]:
    """The terms in blocks of about PASS_TERMS, each as a broadcast set."""
    blocks = -(-terms.count() // PASS_TERMS)
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)
        yield spark.sparkContext.broadcast({row.term.encode() for row in own.collect()})


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms occurs in all documents (`term`, `n`); absent terms are left out."""
    out = None
    for vocabulary in _passes(docs.sparkSession, terms):

        def count(batches: Iterator[pa.RecordBatch], vocabulary=vocabulary) -> Iterator[pa.RecordBatch]:
            known, counts = vocabulary.value, Counter()
            for batch in batches:
                for body in batch.column(0):
                    counts.update(w for w in words_of(body.as_py()) if w in known)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())],
                names=["term", "n"],
            )

        own = docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out if out is not None else docs.sparkSession.createDataFrame([], "term string, n long")


_POSTINGS = "term string, doc_id {id}, body_hash long, positions array<int>"


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional inverted index: for each of the terms and document, the places of the term in it.

    `docs` has doc_id, text and body_hash; the last two together name a document, so rows that share an id but not a
    text stay apart. The index is written to the shared folder.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = _POSTINGS.format(id=id_type.simpleString())
    out = None
    for vocabulary in _passes(docs.sparkSession, terms):

        def post(batches: Iterator[pa.RecordBatch], vocabulary=vocabulary) -> Iterator[pa.RecordBatch]:
            known = vocabulary.value
            for batch in batches:
                found_terms: list[str] = []
                rows: list[int] = []
                places: list[list[int]] = []
                for row, body in enumerate(batch.column(2)):
                    lists: dict[bytes, list[int]] = {}
                    for at, word in enumerate(words_of(body.as_py())):
                        if word in known:
                            lists.setdefault(word, []).append(at)
                    found_terms += [w.decode() for w in lists]
                    rows += [row] * len(lists)
                    places += lists.values()
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found_terms, pa.string()),
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(places, pa.list_(pa.int32())),
                    ],
                    names=["term", "doc_id", "body_hash", "positions"],
                )

        own = docs.select("doc_id", "body_hash", "text").mapInArrow(post, schema)
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return stage(out, "postings")


def intersect(index: DataFrame, probes: DataFrame, slop: int = SLOP) -> DataFrame:
    """Windows found in documents: phrase, doc_id, body_hash, start, `exact`.

    `probes` has, for each phrase, its rarest terms in order of frequency with their offsets in it. The list of the
    rarest term proposes starts, place less offset; each further list keeps those that have its term at its own
    offset (`exact`) or up to `slop` words from it.
    """
    first = probes.where("rank = 1").select("phrase", "size", "term", "offset")
    found = (
        index.join(first, "term")
        .select(
            "phrase", "size", "doc_id", "body_hash",
            F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start"),
        )
        .withColumn("exact", F.col("start") >= 0)
    )
    for rank in range(2, PROBES + 1):
        further = probes.where(F.col("rank") == rank).select(
            F.col("phrase").alias("_phrase"), F.col("term").alias("_term"), F.col("offset").alias("_offset")
        )
        lists = index.select(
            F.col("term").alias("_t"), F.col("doc_id").alias("_d"), F.col("body_hash").alias("_h"), "positions"
        )
        place = F.col("start") + F.col("_offset")
        with_probe = found.join(further, F.col("phrase") == F.col("_phrase"), "left")
        met = with_probe.where("_term is not null").join(
            lists,
            (F.col("_term") == F.col("_t"))
            & F.col("doc_id").eqNullSafe(F.col("_d"))
            & (F.col("body_hash") == F.col("_h")),
        )
        met = met.where(F.exists("positions", lambda p: F.abs(p - place) <= slop)).withColumn(
            "exact", F.col("exact") & F.array_contains("positions", place)
        )
        # Windows of fewer terms have no further probe.
        short = with_probe.where("_term is null")
        found = met.select(*found.columns).unionByName(short.select(*found.columns))
    return found


def _hits(words: list[bytes], proposed: list[dict]) -> tuple[int, list[dict]]:
    """Words inside any of the proposed windows that are there word by word, and the matches of the text.

    A window that is there gives its exact matches; one that is not, its proximity matches.
    """
    covered, exact, there = np.zeros(len(words) + 1, np.int64), [], set()
    for match in proposed:
        start, end = match["start"], match["start"] + match["size"]
        if match["exact"] and b" ".join(words[start:end]).decode() == match["phrase"]:
            covered[start] += 1
            covered[end] -= 1
            exact.append(match)
            there.add(match["phrase"])
    near = [{**match, "exact": False} for match in proposed if match["phrase"] not in there]
    return int((np.cumsum(covered) > 0).sum()), exact + near


def matches(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row for each match: doc_id, body_hash, item_id, start, size, `exact`.

    Exact matches are a window's words at `start`. Proximity matches (`exact` false) are windows that the text does not
    hold as a whole, whose rarest terms stand up to `slop` words from their places; `start` is where the window would
    begin by the place of its rarest term, below 0 where the text begins later. Items without an id, and texts and items
    without words, have no matches; rows that agree in id and text count once.
    """
    items, checked = _search(docs, benchmark, length, slop)
    found = checked.select("doc_id", "body_hash", F.explode("matches").alias("match")).distinct()
    return found.join(items.select(F.col("phrase").alias("_phrase"), "item_id"), F.col("match.phrase") == F.col("_phrase")).select(
        "doc_id", "body_hash", "item_id", "match.start", "match.size", "match.exact"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """For each document: n_words, n_hit (words inside an occurrence of a window of a benchmark item), n_items,
    item_ids (those items, sorted as text), contaminated, and n_near (windows whose rarest terms stand close to their
    places although the window as a whole is not there).

    The rarest terms of each window are looked up in a positional index of the documents; lists are intersected from
    the rarest on, shifted by their offsets, and what is left is compared word by word. Null and empty texts have no
    words and are not contaminated; items without words have no windows. Rows that agree in id and text get the same
    result, rows that agree in the id alone their own. Empty tables are fine on either side.
    """
    items, checked = _search(docs, benchmark, length, slop)
    of_items = (
        checked.where("n_hit > 0")
        .select("doc_id", "body_hash", F.explode(F.filter("matches", lambda match: match["exact"])["phrase"]).alias("phrase"))
        .distinct()
        .join(items.select("phrase", "item_id"), "phrase")
        .groupBy("doc_id", "body_hash")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
        .withColumnRenamed("doc_id", "_d").withColumnRenamed("body_hash", "_h")
    )
    of_items = stage(of_items, "items-found")
    few = count_rows_up_to(of_items, BROADCAST_ROWS // 10) <= BROADCAST_ROWS // 10
    return checked.join(
        F.broadcast(of_items) if few else of_items,
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("body_hash") == F.col("_h")),
        "left",
    ).select(
        "doc_id", "body_hash", "n_words", "n_hit",
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


def _search(docs: DataFrame, benchmark: DataFrame, length: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """Windows of items that have an id, and each document's n_words, n_hit, matches and n_near."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("body_hash"), "text")
    items = stage(benchmark_windows(benchmark, length=length), "benchmark-windows")
    windows = items.select("phrase", "size").distinct()
    placed = windows.select("phrase", "size", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    counts = stage(document_frequencies(rows, placed.select("term").distinct()), "frequencies")
    # A window with a term that no document has cannot occur.
    ranked = (
        placed.join(counts, "term", "left")
        .groupBy("phrase", "size")
        .agg(
            F.slice(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))), 1, PROBES).alias("rarest"),
            F.max(F.col("n").isNull()).alias("absent"),
        )
        .where("not absent")
    )
    probes = stage(
        ranked.select("phrase", "size", F.posexplode("rarest").alias("rank", "probe")).select(
            "phrase", "size", (F.col("rank") + 1).alias("rank"), "probe.term", "probe.offset"
        ),
        "probes",
    )
    index = build_index(rows, probes.select("term").distinct())
    found = stage(intersect(index, probes, slop), "windows-found")
    by_doc = (
        found.groupBy("doc_id", "body_hash")
        .agg(F.collect_list(F.struct("start", "size", "phrase", "exact")).alias("found"))
        .withColumnRenamed("doc_id", "_d").withColumnRenamed("body_hash", "_h")
    )
    by_doc = stage(by_doc, "documents-found")
    few = count_rows_up_to(found, BROADCAST_ROWS) <= BROADCAST_ROWS
    checked = stage(
        rows.join(
            F.broadcast(by_doc) if few else by_doc,
            F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("body_hash") == F.col("_h")),
            "left",
        )
        .select("doc_id", "body_hash", _checked(F.col("text"), F.col("found")).alias("r"))
        .select("doc_id", "body_hash", "r.*"),
        "documents-checked",
    )
    return items.where("item_id is not null"), checked


def without_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """The rows of `docs` that no window of a benchmark item occurs in, with all their columns."""
    found = decontaminate(docs, benchmark, length)
    dirty = stage(
        found.where("contaminated").select(F.col("doc_id").alias("_d"), F.col("body_hash").alias("_h")).distinct(),
        "contaminated",
    )
    few = count_rows_up_to(dirty, BROADCAST_ROWS) <= BROADCAST_ROWS
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"),
        F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_b"),
    )
    return rows.join(
        F.broadcast(dirty) if few else dirty,
        F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_b") == F.col("_h")),
        "left_anti",
    ).select("_row.*")


def _checked(text, found):
    match = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("phrase", pa.string()), ("exact", pa.bool_())])
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("matches", pa.list_(match)), ("n_near", pa.int64())]
    )

    @F.arrow_udf(
        "struct<n_words:long,n_hit:long,matches:array<struct<start:int,size:int,phrase:string,exact:boolean>>,n_near:long>"
    )
    def check(texts: pa.Array, proposals: pa.Array) -> pa.Array:
        out = []
        for body, proposed in zip(texts, proposals):
            words = words_of(body.as_py())
            n_hit, found = _hits(words, proposed.as_py() or [])
            near = {each["phrase"] for each in found if not each["exact"]}
            out.append({"n_words": len(words), "n_hit": n_hit, "matches": found, "n_near": len(near)})
        return pa.array(out, kind)

    return check(text, found)


def items_digest(item_ids):
    return F.sha2(F.array_join(item_ids, ",").cast("binary"), 256)
