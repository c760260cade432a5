"""Links between documents whose sets of word shingles have a high Jaccard similarity: a size-aware join."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import count_rows_up_to
from ledgerloom.llm.graph import components
from ledgerloom.sources.shared import stage

#: Subsets are enumerated for sets up to this size at most, and of this many subsets; the boundary is chosen below it.
SMALL_MOST = 24
SUBSETS_MOST = 1000
#: Shingles of one owner, and those that a task gathers before it sends them to their owners.
OWNED_SHINGLES = 2_000_000
BLOCK_SHINGLES = 2_000_000
#: Sets whose counts are added up together.
COUNTED_SETS = 20_000
#: What a posting of an inverted list costs beside one of a subset: it is met by the others of its list.
SCAN_COST = 4
#: Members of a candidate cluster that one task compares, and shingles of them.
CLUSTER_SETS = 2048
CLUSTER_SHINGLES = 2_000_000
#: Up to so many rows of two numbers are broadcast.
BROADCAST_ROWS = 500_000
#: How often a set with an empty block is dealt anew before its empty blocks count as blocks.
DEALS = 3

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, known: _Words, width: int = 3) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted: runs of `width` words, or all words if there are fewer.
    A-Z count as lower case; words are `[^\\x20\\x09-\\x0D]+`."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for at in range(width):
        total = mix(total * _ODD[at % 3] + hashes[at : len(words) - width + 1 + at])
    return np.unique(total)


class Scheme:
    """Keys such that two sets with a similarity of `percent` or more share one."""

    def __init__(self, percent: int):
        self.percent = percent
        self._starts = [1]
        self._blocks: dict[int, int] = {}
        self._bounds: dict[int, np.ndarray] = {}

    def partner(self, n: int) -> int:
        """The largest size that a set linked with one of size n can have."""
        return 100 * n // self.percent

    def bounds(self, blocks: int) -> np.ndarray:
        """Where the ranges of hash begin, but for the first."""
        if blocks not in self._bounds:
            self._bounds[blocks] = np.array([(i << 64) // blocks for i in range(1, blocks)], np.uint64)
        return self._bounds[blocks]

    def size_class(self, n: int) -> int:
        """Classes are such that linked sets are in one class or in neighbouring ones."""
        while self._starts[-1] <= n:
            self._starts.append(100 * self._starts[-1] // self.percent + 1)
        low, high = 0, len(self._starts) - 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._starts[middle] <= n else (low, middle)
        return low

    def most_differing(self, of_class: int) -> int:
        """In how many elements linked sets differ at most, the smaller of them being of the class."""
        while of_class + 1 >= len(self._starts):
            self.size_class(self._starts[-1])
        n = self._starts[of_class + 1] - 1
        return (n + self.partner(n)) * (100 - self.percent) // (100 + self.percent)

    def blocks(self, of_class: int) -> int:
        """More than the elements in which linked sets differ, by about as many as a set of the class leaves empty."""
        if of_class not in self._blocks:
            differing = self.most_differing(of_class)
            blocks = differing + 1
            for _ in range(8):
                empty = blocks * math.exp(-self._starts[of_class] / blocks)
                blocks = differing + 1 + math.floor(empty + 2 * math.sqrt(empty))
            self._blocks[of_class] = blocks
        return self._blocks[of_class]

    def least_overlap(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def list_keys(self, elements: np.ndarray) -> np.ndarray:
        """Tokens of the inverted lists: the set is cut into blocks by ranges of hash, more than linked sets can differ
        in elements, and a block's token is a hash of all its elements.

        An empty block says nothing and gets no token. Of a set with more full blocks than linked sets can differ in, one
        is untouched by the differences, so its linked sets have it too. A set with fewer is dealt anew by other hashes,
        and so are those linked with it, unless they share a token already. Only sets with too few in every deal get
        tokens for their empty blocks.
        """
        n = len(elements)
        own = self.size_class(n)
        keys = []
        for of_class in {own, max(0, own - 1)}:
            blocks, differing = self.blocks(of_class), self.most_differing(of_class)
            bounds = self.bounds(blocks)
            dealt = elements
            for deal in range(DEALS):
                if deal:
                    dealt = np.sort(mix(elements + _ODD[deal]))
                edges = np.concatenate(([0], np.searchsorted(dealt, bounds), [n]))
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(dealt ^ _ODD[2]))))
                tokens = sums[edges[1:]] - sums[edges[:-1]]
                salt = mix(np.arange(blocks, dtype=np.uint64) + np.uint64((of_class * DEALS + deal) << 32 | 1 << 62))
                tokens = mix(tokens ^ salt)
                full = edges[1:] > edges[:-1]
                enough = full.sum() > differing
                keys.append(tokens[full] if enough or deal < DEALS - 1 else tokens)
                if enough:
                    break
        return np.unique(np.concatenate(keys))

    def small_most(self) -> int:
        """The largest size, up to SMALL_MOST, whose sets have no more than SUBSETS_MOST subsets of any kind."""
        best = 0
        for n in range(1, SMALL_MOST + 1):
            dropped = [n - self.least_overlap(n, m) for m in range(-(-self.percent * n // 100), self.partner(n) + 1)]
            if max(math.comb(n, d) for d in dropped if d >= 0) > SUBSETS_MOST:
                break
            best = n
        return best

    def subset_keys(self, elements: np.ndarray) -> np.ndarray:
        """For each size that a linked set can have: a hash of every subset of the size that the two must share."""
        n = len(elements)
        marks = mix(elements ^ _ODD[1])
        total = marks.sum(dtype=np.uint64)
        keys = []
        for m in range(-(-self.percent * n // 100), self.partner(n) + 1):
            pair = (min(n, m), max(n, m))
            dropped = n - self.least_overlap(n, m)
            if dropped < 0:
                continue
            gone = np.array([sum(map(int, c)) & (2**64 - 1) for c in itertools.combinations(marks, dropped)], np.uint64)
            keys.append(mix((total - gone) ^ mix(np.array([pair[0] << 32 | pair[1]], np.uint64))))
        return np.unique(np.concatenate(keys))


_SETS = "doc_id {id}, body_hash long, n_shingles long, sid long"


def set_id(elements: np.ndarray) -> int:
    """A set's name: a 64-bit hash of its elements and their number."""
    total = np.array([elements.sum(dtype=np.uint64), mix(elements ^ _ODD[0]).sum(dtype=np.uint64)], np.uint64)
    return int(mix(mix(total[:1] + np.uint64(len(elements))) ^ total[1:]).view(np.int64)[0])


def _longs(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """One row for each document: number of shingles, name of the set."""
    schema = _SETS.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for piece in _pieces(batch):
                sizes, sids = [], []
                for text in piece.column(2):
                    elements = shingles(text.as_py(), known, width)
                    sizes.append(len(elements))
                    sids.append(set_id(elements) if len(elements) else 0)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64())],
                    names=["doc_id", "body_hash", "n_shingles", "sid"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("body_hash"), "text").mapInArrow(run, schema)


def _sent(sets: list[np.ndarray], sids: list[int], owners: int) -> pa.RecordBatch:
    """The shingles of some sets by owner: the low half of each in order, and which of the owner's sets it is from."""
    everything = np.concatenate(sets)
    of_set = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
    owner = ((everything >> np.uint64(32)) % np.uint64(owners)).astype(np.uint32)
    order = np.argsort(owner.astype(np.uint64) << np.uint64(32) | everything & np.uint64(0xFFFFFFFF))
    low, owner, of_set = everything[order].astype(np.uint32), owner[order], of_set[order]
    names = np.array(sids, np.int64)
    edges = np.concatenate((np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0], [len(owner)]))
    rows = {"owner": [], "low": [], "of_set": [], "sids": []}
    for start, end in zip(edges[:-1], edges[1:]):
        present, local = np.unique(of_set[start:end], return_inverse=True)
        rows["owner"].append(int(owner[start]))
        # The bytes of one place stand together: those of high places hardly change, so they take little room.
        rows["low"].append(low[start:end].view(np.uint8).reshape(-1, 4).T.tobytes())
        rows["of_set"].append(local.astype(np.uint16 if len(present) <= 65536 else np.uint32).tobytes())
        rows["sids"].append(names[present].tobytes())
    return pa.RecordBatch.from_pydict({"owner": pa.array(rows["owner"], pa.int64())} | {
        name: pa.array(rows[name], pa.binary()) for name in ("low", "of_set", "sids")
    })


def _shared_of_owner(blocks: pa.Table, parts: int) -> pa.Table:
    """For each set, how many of its shingles at this owner another set has too: a row for each part of the sets."""
    lows, names = [], []
    for low, of_set, sids in zip(blocks["low"], blocks["of_set"], blocks["sids"]):
        low = np.frombuffer(low.as_py(), np.uint8).reshape(4, -1)
        count = low.shape[1]
        of_set = np.frombuffer(of_set.as_py(), np.uint16 if len(of_set.as_py()) == 2 * count else np.uint32)
        lows.append(np.ascontiguousarray(low.T).view(np.uint32).ravel())
        names.append(np.frombuffer(sids.as_py(), np.int64)[of_set])
    low, name = np.concatenate(lows), np.concatenate(names)
    order = np.lexsort((name, low))
    low, name = low[order], name[order]
    # A set that several tasks have met counts once.
    new = np.append(True, (low[1:] != low[:-1]) | (name[1:] != name[:-1]))
    low, name = low[new], name[new]
    starts = np.nonzero(np.append(True, low[1:] != low[:-1]))[0]
    lengths = np.diff(np.append(starts, len(low)))
    sids, shared = np.unique(name[np.repeat(lengths > 1, lengths)], return_counts=True)
    part = (mix(sids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    sids, shared, part = sids[order], shared[order].astype(np.uint32), part[order]
    edges = np.concatenate((np.nonzero(np.append(True, part[1:] != part[:-1]))[0], [len(part)])) if len(part) else [0]
    spans = list(zip(edges[:-1], edges[1:]))
    return pa.table(
        {
            "part": pa.array([int(part[start]) for start, _ in spans], pa.int64()),
            "sids": pa.array([sids[start:end].tobytes() for start, end in spans], pa.binary()),
            "shared": pa.array([shared[start:end].tobytes() for start, end in spans], pa.binary()),
        }
    )


def _shared_of_sets(counts: pa.Table) -> pa.Table:
    """The counts of a part of the sets, added up over all owners."""
    sids = np.concatenate([np.frombuffer(body.as_py(), np.int64) for body in counts["sids"]])
    shared = np.concatenate([np.frombuffer(body.as_py(), np.uint32) for body in counts["shared"]])
    names, at = np.unique(sids, return_inverse=True)
    sums = np.bincount(at, shared, minlength=len(names)).astype(np.int64)
    return pa.table({"sid": pa.array(names), "shared": pa.array(sums)})


def in_company(docs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """`sid` of the sets that can have a link: as many of their shingles as a link needs are also in other sets.

    Shingles travel once, in compact blocks, to the owner of a range of hashes, without the text. An owner tells two
    shingles apart by 32 bits of their hash and the range; where it fails to, a set stays that could have gone. Most
    documents have more shingles of their own than a link allows, so what follows works on few sets.
    """
    rows, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    owners, parts = max(1, -(-total // OWNED_SHINGLES)), max(1, -(-rows // COUNTED_SETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Words(), set()
        parts, sids, held = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                elements = shingles(text.as_py(), known, width)
                if not len(elements):
                    continue
                sid = set_id(elements)
                if sid in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(sid)
                parts.append(elements)
                sids.append(sid)
                held += len(elements)
                if held > BLOCK_SHINGLES:
                    yield _sent(parts, sids, owners)
                    parts, sids, held = [], [], 0
        if parts:
            yield _sent(parts, sids, owners)

    blocks = docs.select("text").mapInArrow(run, "owner long, low binary, of_set binary, sids binary")
    counts = blocks.groupBy("owner").applyInArrow(
        lambda own: _shared_of_owner(own, parts), "part long, sids binary, shared binary"
    )
    shared = counts.groupBy("part").applyInArrow(_shared_of_sets, "sid long, shared long")
    sizes = sets.where("n_shingles > 0").select("sid", "n_shingles").distinct()
    return sizes.join(shared, "sid").where(f"100 * shared >= {percent} * n_shingles").select("sid", "n_shingles")


def _keyed(docs: DataFrame, sets: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """`sid`, `n_shingles`, `elements` (the shingles), `lists` and `subsets` (keys) of the member sets."""
    texts = _texts(docs, sets, members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scheme = _Words(), Scheme(percent)
        small, none = scheme.small_most(), np.empty(0, np.uint64)
        for batch in batches:
            for piece in _pieces(batch, 128):
                found = [shingles(text.as_py(), known, width) for text in piece.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), pa.array([len(e) for e in found], pa.int64()),
                        pa.array([e.tobytes() for e in found], pa.binary()),
                        _longs([scheme.list_keys(e) for e in found]),
                        _longs([scheme.subset_keys(e) if len(e) <= small else none for e in found]),
                    ],
                    names=["sid", "n_shingles", "elements", "lists", "subsets"],
                )

    schema = "sid long, n_shingles long, elements binary, lists array<long>, subsets array<long>"
    return texts.select("sid", "text").mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def boundary(sets: DataFrame, most: int = SMALL_MOST) -> int:
    """The size up to which subsets are enumerated: where their keys and the lists of all larger sets cost least.

    The driver sees one row for each size up to `most`."""
    costs = (
        sets.where((F.size("lists") > 0) & (F.col("n_shingles") <= most))
        .groupBy("n_shingles")
        .agg(F.sum(F.size("subsets")).alias("subsets"), F.sum(F.size("lists")).alias("lists"))
        .collect()
    )
    by_size = {row.n_shingles: (row.subsets, row.lists * SCAN_COST) for row in costs}

    def cost(x: int) -> int:
        return sum(subsets if n <= x else lists for n, (subsets, lists) in by_size.items())

    return min(range(most + 1), key=lambda x: (cost(x), x))


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) from every set to the smallest of each key that it shares: linked sets are connected by them."""
    x = boundary(sets, Scheme(percent).small_most())
    as_list = F.when(F.floor(F.col("n_shingles") * 100 / percent) > x, F.col("lists"))
    as_subset = F.when(F.col("n_shingles") <= x, F.col("subsets"))
    empty = F.array().cast("array<long>")
    postings = sets.where(F.size("lists") > 0).select(
        "sid", F.explode(F.concat(F.coalesce(as_list, empty), F.coalesce(as_subset, empty))).alias("key")
    )
    shared = stage(
        postings.groupBy("key")
        .agg(F.min("sid").alias("least"), F.max("sid").alias("most"))
        .where("least < most")
        .select("key", "least"),
        "shared-keys",
    )
    return (
        postings.join(shared, "key")
        .where("sid != least")
        .select(F.col("sid").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of places in the list that span the components of all links among the sets.

    The overlaps of one set with all others are counted by scanning the lists of its elements. The set that has most
    in common with the others comes first; whatever is connected with it need not be scanned itself, as its links to
    the rest show up when the rest is.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(count), sizes)
    _, element, frequency = np.unique(everything, return_inverse=True, return_counts=True)
    by_element = owner[np.argsort(element, kind="stable")]
    first = np.concatenate(([0], np.cumsum(frequency)))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    central = np.add.reduceat(frequency[element], starts[:-1]) / sizes
    parent = list(range(count))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = np.lexsort((np.arange(count), -central)).tolist()
    edges = []
    for i in order:
        if i != order[0] and root(i) == root(order[0]):
            continue
        # Elements that no other set has are left out, so sets without company cost nothing.
        own = element[starts[i] : starts[i + 1]]
        own = own[frequency[own] > 1]
        if not len(own):
            continue
        lengths = frequency[own]
        at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        overlap = np.bincount(by_element[at], minlength=count)
        close = 100 * overlap >= percent * (sizes + sizes[i] - overlap)
        for j in np.nonzero(close)[0].tolist():
            if root(i) != root(j):
                parent[root(j)] = root(i)
                edges.append((i, j))
    return edges


def _verified(percent: int):
    def run(cluster: pa.Table) -> pa.Table:
        by_name = dict(zip(cluster["sid"].to_pylist(), cluster["elements"]))
        names = sorted(by_name)
        sets = [np.frombuffer(by_name[name].as_py(), np.uint64) for name in names]
        edges = linked(sets, percent)
        return pa.table(
            {
                "a": pa.array([names[i] for i, _ in edges], pa.int64()),
                "b": pa.array([names[j] for _, j in edges], pa.int64()),
            }
        )

    return run


def _texts(docs: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """`sid` and `text` of the member sets, each from one document that has it."""
    named = sets.join(members.select("sid"), "sid").groupBy("sid")
    sources = stage(
        named.agg(F.min(F.struct("doc_id", "body_hash")).alias("_of")).select(
            "sid", F.col("_of.doc_id").alias("_d"), F.col("_of.body_hash").alias("_h")
        ),
        "member-documents",
    )
    few = count_rows_up_to(sources, BROADCAST_ROWS) <= BROADCAST_ROWS
    texts = docs.select("doc_id", F.xxhash64("text").alias("body_hash"), "text").join(
        F.broadcast(sources) if few else sources,
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("body_hash") == F.col("_h")),
    )
    return texts.select("sid", "text")


def links(keyed: DataFrame, percent: int) -> DataFrame:
    """Edges that span the components of all links: candidate clusters are compared set by set.

    A cluster above CLUSTER_SETS sets or CLUSTER_SHINGLES shingles is cut into blocks, and each two blocks are
    compared by a task of their own.
    """
    clusters = stage(components(candidates(keyed, percent)), "clusters")
    sizes = keyed.select(F.col("sid").alias("node"), "n_shingles").distinct()
    members = stage(clusters.join(sizes, "node").withColumnRenamed("node", "sid"), "members")
    loads = members.groupBy("root").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / CLUSTER_SETS), F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES)
        ).alias("blocks")
    )
    placed = (
        members.join(loads, "root")
        .withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
        # A block meets every other one; a cluster of one block meets itself.
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .where("blocks = 1 or block != other")
        .select("sid", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    return (
        keyed.select("sid", "elements").join(placed, "sid")
        .groupBy("root", "i", "j")
        .applyInArrow(_verified(percent), "a long, b long")
    )


def near_duplicates(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """For each document: body_hash (of the text), n_shingles and component_id, the smallest doc_id that links lead to.

    Two documents link when their sets of `width`-word shingles have a Jaccard similarity of `percent` / 100 or more.
    Sets with too many shingles of their own for any link are found first. Of the others, sets up to a size chosen by
    cost share the hash of a subset of fixed size, larger ones an entry of inverted lists of blocks; what shares a key is
    compared exactly. Equal sets are one node, so copies are never compared. A set is
    named by 64 bits; among a billion sets, two get the same name with a probability of 3 %.

    Null and empty texts, and texts of blanks, have no shingles and link with nothing. Rows with equal texts, repeated
    rows among them, are in one component. A null id never is a component's smallest; a component of null ids alone
    has a null id. An empty table gives no rows. `docs` may have further columns, which are not read.
    """
    sets = stage(_sets(docs, width), "sets")
    members = stage(in_company(docs, sets, percent, width), "in-company")
    keyed = stage(_keyed(docs, sets, members, percent, width), "keyed")
    spanning = stage(links(keyed, percent), "links")
    roots = components(spanning).withColumnRenamed("node", "sid")
    classes = sets.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    placed = classes.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(placed.join(least, "root").select("sid", "component_id"), "components")
    return (
        sets.select("doc_id", "body_hash", "n_shingles", "sid")
        .join(named, (F.col("n_shingles") > 0) & (sets["sid"] == named["sid"]), "left")
        .select(
            "doc_id", "body_hash", "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def one_of_each(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """The rows of `docs` but for near duplicates: of each component the document with the smallest id stays.

    Documents without shingles all stay. Of rows that agree in id and text, one stays. Rows that share the smallest id
    of their component but not its text all stay. All columns are kept, whatever their names.
    """
    found = stage(near_duplicates(docs, percent, width), "near-duplicates")
    dropped = found.where((F.col("n_shingles") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_d"), F.col("body_hash").alias("_h")
    )
    few = count_rows_up_to(dropped, BROADCAST_ROWS) <= BROADCAST_ROWS
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"),
        F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_b"),
    )
    kept = rows.join(
        F.broadcast(dropped) if few else dropped,
        F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_b") == F.col("_h")),
        "left_anti",
    )
    names = found.where("n_shingles > 0").select("doc_id", "body_hash")
    if names.count() > names.distinct().count():
        # Repeated rows.
        blank = F.coalesce(F.col("_row.text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z")
        kept = kept.where(~blank).dropDuplicates(["_i", "_b"]).unionByName(kept.where(blank))
    return kept.select("_row.*")
