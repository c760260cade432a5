"""Repeated substrings over all documents, decided by suffix arrays of anchored pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import count_rows_up_to
from ledgerloom.llm.jaccard import mix
from ledgerloom.llm.suffixes import suffix_arrays
from ledgerloom.sources.shared import stage

#: Strings of so many bytes that occur earlier are removed.
LENGTH = 100
#: Bytes of an anchor. Each string of LENGTH bytes has one: the piece of this length in it with the least hash.
ANCHOR = 40
#: Distinct pieces of one anchor that are sorted together; an anchor with more is cut into parts.
PIECES = 32
#: Bytes whose suffixes are sorted in one go, text by text.
BATCH_BYTES = 400_000
#: Up to so many rows of a few numbers are broadcast.
BROADCAST_ROWS = 500_000
#: Pieces that a task remembers to merge copies before the shuffle.
REMEMBERED = 50_000
#: Bytes of a long text that are hashed at once.
SEGMENT = 1 << 19

_PLACE_BITS = np.uint64(20)
_PLACE_MASK = np.uint64((1 << 20) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Hasher:
    """Hashes of all pieces of ANCHOR bytes of a text, by differences of one running sum."""

    def __init__(self):
        self._bytes = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        powers = np.full(SEGMENT + LENGTH, _BASE, np.uint64)
        powers[0] = 1
        self._up = np.cumprod(powers)
        powers[1:] = inverse
        self._down = np.cumprod(powers)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._bytes[data] * self._up[: len(data)], out=sums[1:])
        return mix((sums[ANCHOR:] - sums[:-ANCHOR]) * self._down[: len(data) - ANCHOR + 1])


def anchors(data: np.ndarray, hasher: _Hasher) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of starts whose strings of LENGTH bytes share an anchor: first start, number of starts, the anchor's hash
    and its place. The anchor is the last piece with the least hash, so equal strings have it at the same offset."""
    width = LENGTH - ANCHOR + 1
    for begin in range(0, max(0, len(data) - LENGTH + 1), SEGMENT - LENGTH + 1):
        part = data[begin : begin + SEGMENT]
        if len(part) < LENGTH:
            break
        hashes = hasher(part)
        places = np.arange(len(hashes), dtype=np.uint64)
        least = (hashes & ~_PLACE_MASK) | (_PLACE_MASK - places)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            rest = width - span
            least = np.minimum(least[:-rest], least[rest:])
        place = (_PLACE_MASK - (least & _PLACE_MASK)).astype(np.int64)
        first = np.nonzero(np.concatenate(([True], place[1:] != place[:-1])))[0]
        count = np.diff(np.append(first, len(place)))
        at = place[first]
        yield first + begin, count, hashes[at], at + begin


def _keys(docs: DataFrame) -> DataFrame:
    """Documents named by (ord, h): the id, null after all others, and a hash of the text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("ord"),
        F.xxhash64("text").alias("h"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _copies(keyed: DataFrame) -> DataFrame:
    """(ord, h) of the documents whose whole text a document with a smaller id has."""
    names = keyed.where(F.octet_length("text") > 0).select(
        "ord", "h", F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("n")
    )
    first = names.groupBy("h", "h2", "n").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    several = first.where("first < last").drop("last")
    return (
        names.select("ord", "h", "h2", "n").distinct()
        .join(several, ["h", "h2", "n"])
        .where("ord > first")
        .select("ord", "h")
    )


def _places(texts: DataFrame) -> DataFrame:
    """Every run of starts with one anchor: the anchor, the document, first start, starts, the anchor's offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        rows: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            types = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
            columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.empty(0)] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c.astype(t, copy=False)) for c, t in zip(columns, types)],
                names=["anchor", "ord", "h", "start", "n", "offset"],
            )

        for batch in batches:
            for ord_, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                for first, count, hashes, place in anchors(data, hasher):
                    found = len(first)
                    document = np.full(found, ord_, np.int64), np.full(found, h, np.int64)
                    rows.append((hashes.view(np.int64), *document, first, count, place - first))
                    size += found
                    if size > 200_000:
                        yield out()
                        rows, size = [], 0
        yield out()

    return texts.select("ord", "h", "text").mapInArrow(
        run, "anchor long, ord long, h long, start long, n int, offset int"
    )


def _repeated(places: DataFrame) -> DataFrame:
    """The places whose anchor occurs more than once, by a shuffle at every size.

    The repeated anchors are written first, so that the join reads two plain shuffles and a frequent anchor's places
    can be read by several tasks.
    """
    counts = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    return places.join(stage(counts, "anchors").hint("merge"), "anchor", "left_semi")


_PIECE = "anchor long, ord long, h long, start long, offset int, body binary"


def _pieces(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The text around the given places of anchors, as far as strings of LENGTH bytes with this anchor reach.

    The places of a document, fewer than its bytes, meet at its text. Copies of a piece that one task meets are merged:
    all but the earliest come out as pieces without a body, for they are repeated as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest: dict[tuple, tuple] = {}
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = zip(*rows) if rows else [()] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)],
                names=["anchor", "ord", "h", "start", "offset", "body"],
            )

        for batch in batches:
            documents = zip(*(batch.column(name) for name in ("ord", "h", "text", "places")))
            for ord_, h, text, found in documents:
                raw, ord_, h = text.as_py().encode(), ord_.as_py(), h.as_py()
                fields = found.values.flatten()
                for name, start, n, offset in zip(*(field.to_pylist() for field in fields)):
                    body = raw[start : start + n + LENGTH - 1]
                    key, here = (name, offset, body), (ord_, h, start)
                    known = earliest.get(key)
                    if known is None:
                        earliest[key] = here
                        continue
                    if known == here:  # a repeated row
                        continue
                    late = max(known, here)
                    earliest[key] = min(known, here)
                    # The number of its bytes stands in for the body of what is repeated as a whole.
                    rows.append((name, *late, -len(body), None))
                if len(earliest) > REMEMBERED:
                    rows += [(name, *here, offset, body) for (name, offset, body), here in earliest.items()]
                    earliest = {}
                if len(rows) > 20_000:
                    yield out()
                    rows = []
        rows += [(name, *here, offset, body) for (name, offset, body), here in earliest.items()]
        yield out()

    # As a set: rows that repeat a document as a whole name the same places.
    by_document = places.groupBy("ord", "h").agg(
        F.collect_set(F.struct("anchor", "start", "n", "offset")).alias("places")
    )
    return (
        texts.join(by_document.hint("merge"), ["ord", "h"])
        .select("ord", "h", "text", "places")
        .mapInArrow(run, _PIECE)
    )


_FOUND = "ord long, h long, start long, end long, w1 long, w2 long"


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), "<u8", padded.tobytes(), 0, (1,))


def _decide(lanes: list[list[tuple]]) -> tuple[list[tuple], list[tuple]]:
    """Repeated stretches and, for lanes that are parts of an anchor, the earliest place of every string.

    A lane is a list of (bodies in it, is a part). The suffixes of each lane's bodies are sorted; strings of LENGTH
    bytes that are equal are then neighbours, and all but the earliest are repeated.
    """
    texts, starts, owners = [], [], []
    size = 0
    for lane, (bodies, _) in enumerate(lanes):
        starts.append(size)
        for number, (body, *_rest) in enumerate(bodies):
            texts.append(np.frombuffer(body, np.uint8).astype(np.uint16) + 2)
            texts.append(np.array([1 if number + 1 < len(bodies) else 0], np.uint16))
            owners.append((lane, number, size))
            size += len(body) + 1
    text = np.concatenate(texts)
    order = suffix_arrays(text, np.array(starts))
    begins = np.array([begin for _, _, begin in owners])
    owner = np.searchsorted(begins, order, side="right") - 1
    lengths = np.diff(np.append(begins, size)) - 1
    whole = order - begins[owner] + LENGTH <= lengths[owner]
    order, owner = order[whole], owner[whole]
    if not len(order):
        return [], []
    eights = _eights(np.where(text >= 2, text - 2, 0).astype(np.uint8))
    lane_of = np.array([lane for lane, _, _ in owners])[owner]
    same = lane_of[1:] == lane_of[:-1]
    for at in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        same &= eights[order[1:] + at] == eights[order[:-1] + at]
    string = np.concatenate(([0], np.cumsum(~same)))
    # The earliest of each string: by id, text, place.
    facts = [lanes[lane][0][number] for lane, number, _ in owners]
    ords, hs, firsts = (np.array([fact[i] for fact in facts], np.int64)[owner] for i in (1, 2, 3))
    place = firsts + order - begins[owner]
    sorted_ = np.lexsort((place, hs, ords, string))
    leads = np.ones(len(sorted_), bool)
    leads[1:] = string[sorted_][1:] != string[sorted_][:-1]
    late = sorted_[~leads]
    repeated = []
    flat = np.lexsort((place[late], owner[late]))
    late = late[flat]
    if len(late):
        breaks = np.nonzero((owner[late][1:] != owner[late][:-1]) | (place[late][1:] != place[late][:-1] + 1))[0] + 1
        for a, b in zip(np.append(0, breaks).tolist(), np.append(breaks, len(late)).tolist()):
            i, j = late[a], late[b - 1]
            repeated.append((int(ords[i]), int(hs[i]), int(place[i]), int(place[j]) + LENGTH, None, None))
    is_part = np.array([part for _, part in lanes])[lane_of]
    lead = sorted_[leads]
    lead = lead[is_part[lead]]
    w1, w2 = np.zeros(len(lead), np.uint64), np.zeros(len(lead), np.uint64)
    for at in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        w1 = mix(w1 * _BASE + eights[order[lead] + at])
        w2 = mix((w2 ^ eights[order[lead] + at]) * _BASE + np.uint64(at))
    earliest = [
        (int(ords[i]), int(hs[i]), int(place[i]), int(place[i]) + LENGTH, int(a), int(b))
        for i, a, b in zip(lead, w1.view(np.int64), w2.view(np.int64))
    ]
    return repeated, earliest


def _sort_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of anchor and part: lanes of whole parts, sorted in batches of lanes of like size."""
    found: list[tuple] = []
    lanes: list[tuple[list[tuple], bool]] = []
    size = 0
    now, bodies, part = None, {}, False

    def close() -> None:
        nonlocal size
        if len(bodies) > 1 or (bodies and part):
            lane = [(body, *here) for (_, body), here in bodies.items()]
            for at in range(0, len(lane), 2 * PIECES):
                cut = lane[at : at + 2 * PIECES]
                lanes.append((cut, part or len(lane) > 2 * PIECES))
                size += sum(len(body) for body, *_ in cut)

    def out() -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in columns], names=["ord", "h", "start", "end", "w1", "w2"]
        )

    def sort_lanes() -> None:
        lanes.sort(key=lambda lane: sum(len(body) for body, *_ in lane[0]))
        for half in (lanes[: len(lanes) // 2], lanes[len(lanes) // 2 :]):
            if half:
                repeated, earliest = _decide(half)
                found.extend(repeated + earliest)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for anchor, ord_, h, start, offset, body, block, blocks in zip(*columns):
            if (anchor, block) != now:
                close()
                now, bodies, part = (anchor, block), {}, blocks > 1
                if size > BATCH_BYTES:
                    sort_lanes()
                    yield out()
                    lanes, size, found = [], 0, []
            here = (ord_, h, start)
            known = bodies.get((offset, body))
            if known is None:
                bodies[(offset, body)] = here
            elif known != here:
                late = max(known, here)
                bodies[(offset, body)] = min(known, here)
                found.append((*late, late[2] + len(body), None, None))
        if len(found) > 50_000:
            yield out()
            found = []
    close()
    sort_lanes()
    yield out()


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(ord, h, start, end): stretches of documents that are covered by strings which occur earlier."""
    places = stage(_places(docs), "places")
    pieces = stage(_pieces(docs, _repeated(places)), "pieces")
    whole = pieces.where("body is null").select(
        "ord", "h", "start", (F.col("start") - F.col("offset")).alias("end")
    )
    rest = pieces.where("body is not null")
    many = stage(
        rest.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECES)
        .select("anchor", F.ceil(F.col("n") / PIECES).alias("blocks")),
        "frequent-anchors",
    )
    few = count_rows_up_to(many, BROADCAST_ROWS) <= BROADCAST_ROWS
    placed = (
        rest.join(F.broadcast(many) if few else many, "anchor", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("body"), F.col("blocks")))
        .select("anchor", "ord", "h", "start", "offset", "body", "block", "blocks")
    )
    found = stage(
        placed.repartition("anchor", "block").sortWithinPartitions("anchor", "block").mapInArrow(_sort_pieces, _FOUND),
        "sorted-pieces",
    )
    decided = found.where("w1 is null").select("ord", "h", "start", "end")
    # Anchors in parts: the parts' earliest places of a string meet once more.
    open_ = found.where("w1 is not null")
    least = open_.groupBy("w1", "w2").agg(F.min(F.struct("ord", "h", "start")).alias("least"))
    late = (
        open_.join(least, ["w1", "w2"])
        .where(F.struct("ord", "h", "start") != F.col("least"))
        .select("ord", "h", "start", "end")
    )
    return whole.unionByName(decided).unionByName(late)


def _cut(text: Column, ranges: Column, copy: Column) -> Column:
    kind = pa.struct(
        [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
         ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    @F.arrow_udf(
        "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,spans:array<struct<start:long,end:long>>>"
    )
    def cut(texts: pa.Array, found: pa.Array, copies: pa.Array) -> pa.Array:
        out = []
        for text, given, is_copy in zip(texts, found, copies.to_pylist()):
            data = text.as_py().encode()
            given = sorted((r["start"], r["end"]) for r in given.as_py() or [])
            if is_copy and len(data) >= LENGTH:
                given = [(0, len(data))]
            spans: list[list[int]] = []
            for start, end in given:
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            digest, at = hashlib.sha256(), 0
            for start, end in spans:
                digest.update(data[at:start])
                at = end
            digest.update(data[at:])
            out.append(
                {
                    "n_bytes": len(data),
                    "n_removed": sum(b - a for a, b in spans),
                    "n_spans": len(spans),
                    "kept_sha256": digest.hexdigest(),
                    "spans": [{"start": a, "end": b} for a, b in spans],
                }
            )
        return pa.array(out, kind)

    return cut(text, ranges, copy)


def without_repeats(docs: DataFrame) -> DataFrame:
    """For each document: n_bytes, n_removed, n_spans, kept_sha256 and the removed `spans` (bytes, end exclusive).

    A byte goes if a string of LENGTH bytes around it starts earlier, in a document with a smaller id or before it in
    the same one; strings never reach over the end of a document, and are judged on the texts as given. Each string
    has an anchor inside it that depends on its bytes alone; the text around repeated anchors is gathered by anchor,
    and the suffix arrays of those pieces show which strings are equal. Whole copies of a text are settled before.

    Null texts are empty. Rows that agree in id and text are one document; among rows that share an id but not a
    text, the one with the smaller text hash is earlier. Null ids come after all others. Empty tables give no rows.
    """
    keyed = _keys(docs)
    copies = stage(_copies(keyed), "copies").withColumn("copy", F.lit(True))
    few = count_rows_up_to(copies, BROADCAST_ROWS) <= BROADCAST_ROWS
    firsts = keyed.where(F.octet_length("text") >= LENGTH).join(
        F.broadcast(copies) if few else copies, ["ord", "h"], "left_anti"
    )
    ranges = repeated_ranges(firsts)
    by_doc = stage(
        ranges.groupBy("ord", "h").agg(F.collect_set(F.struct("start", "end")).alias("found")), "repeats"
    )
    marks = copies.join(by_doc, ["ord", "h"], "full")
    marks = stage(marks, "marks")
    small = marks.agg(F.sum(F.coalesce(F.size("found"), F.lit(0)) + 1)).first()[0] or 0
    rows = docs.select("doc_id", "text").withColumns(
        {
            "ord": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)),
            "h": F.xxhash64("text"),
        }
    )
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    joined = rows.join(F.broadcast(marks) if small <= BROADCAST_ROWS else marks, ["ord", "h"], "left")
    return joined.select(
        "doc_id", _cut(F.col("text"), F.col("found"), F.coalesce("copy", F.lit(False))).alias("r")
    ).select("doc_id", "r.*")
