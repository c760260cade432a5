"""Phrases that stick together: counted by multikey three-way quicksort of suffix pointers, scored at their weakest cut."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.jaccard import mix
from ledgerloom.sources.shared import stage

#: Words in a phrase at most, and occurrences of a phrase at least.
LONGEST = 4
LEAST = 30
#: A phrase goes when a longer one around it has this share of its occurrences, in percent.
COVERED = 80
#: Score of a phrase whose parts only occur in it, times 2.
SCALE = 2_000_000
#: Phrases returned for each language.
BEST = 2000
#: Suffix pointers that a task sorts at once, and tokens that a task gathers before it sends their suffixes.
SORTED = 500_000
BLOCK_TOKENS = 500_000
#: Words that a task counts before it sends the counts.
COUNTED = 250_000
#: A word with more occurrences than this is hot, or with more than a share of 1 / HOT_WORDS of all.
HOT = 200_000
HOT_WORDS = 1 << 20
#: The filter of frequent words has so many bits a word, and 2 ** MOST_BITS bits at most.
BITS_PER_WORD = 16
MOST_BITS = 27
#: Parts that a language's ranking is cut into.
PARTS = 64

_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
#: 0xFF is in no UTF-8 text.
_PLAIN = bytes.maketrans(_DELIMITERS + bytes(range(65, 91)), b"\xff" * len(_DELIMITERS) + bytes(range(97, 123)))
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
#: Bits of the hashes of one to four leading words in the order of suffixes.
_WIDTHS = np.array([20, 18, 14, 12], np.uint64)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, and b"\\xff" between pieces."""
    if not text:
        return []
    return text.encode().translate(_PLAIN).replace(b"\xff", b" \xff ").split()


def word_id(lang: str, word: bytes) -> int:
    """A word of a language as 64 bits, never 0."""
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode())) or 1


# --- words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words by language; the row without a word has the number of all."""
    counts: dict[str, dict[bytes, int]] = {}
    held = 0

    def rows() -> pa.RecordBatch:
        langs, words, ids, found = [], [], [], []
        for lang, own in counts.items():
            own.pop(b"\xff", None)
            langs += [lang] * (len(own) + 1)
            words += [*own, None]
            ids += [word_id(lang, word) for word in own] + [0]
            found += [*own.values(), sum(own.values())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(found, pa.int64()),
            ],
            names=["lang", "word", "id", "f"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            own = counts.setdefault(lang.as_py(), {})
            before = len(own)
            for word in tokens(text.as_py()):
                own[word] = own.get(word, 0) + 1
            held += len(own) - before
            if held > COUNTED:
                yield rows()
                counts.clear()
                held = 0
    if counts:
        yield rows()


def word_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The words with `least` occurrences or more (`lang`, `word`, `id`, `f`), and `lang`, `n` for all languages."""
    counted = stage(
        docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
        .mapInArrow(_counted, "lang string, word string, id long, f long")
        .groupBy("lang", "word", "id")
        .agg(F.sum("f").alias("f"))
        .where(f"f >= {least} or word is null"),
        "words",
    )
    return counted.where("word is not null"), counted.where("word is null").select("lang", F.col("f").alias("n"))


def _filter(words: DataFrame, frequent: int) -> tuple[np.ndarray, int]:
    """A bitmap with a bit for every frequent word. Of 2 ** MOST_BITS bits at most, so it is small at any size of the
    corpus; with more words it lets more of the infrequent ones pass, which the sort then abandons."""
    power = min(MOST_BITS, max(15, math.ceil(math.log2(1 + frequent * BITS_PER_WORD))))
    bits = np.zeros(1 << power, bool)
    at = F.col("id").bitwiseAND(F.lit((1 << power) - 1))
    pieces = (
        words.select(F.shiftright(at, 15).alias("piece"), at.bitwiseAND(F.lit(32767)).alias("bit"))
        .groupBy("piece")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    for row in pieces.toLocalIterator():
        bits[row.piece << 15 : (row.piece + 1) << 15] = np.unpackbits(
            np.frombuffer(row.bits, np.uint8), bitorder="little"
        )
    return np.packbits(bits, bitorder="little"), power


class _Ids(dict):
    """Ids of a language's words, 0 for boundaries and for words that the filter knows to be infrequent."""

    def __init__(self, lang: str, bitmap: np.ndarray, power: int):
        super().__init__({b"\xff": 0})
        self._lang, self._bitmap, self._mask = lang, bitmap, (1 << power) - 1

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
            self[b"\xff"] = 0
            return self[word]
        key = word_id(self._lang, word)
        at = key & self._mask
        value = self[word] = key if self._bitmap[at >> 3] >> (at & 7) & 1 else 0
        return value


# --- suffixes


def windows(ids: np.ndarray) -> np.ndarray:
    """The first LONGEST words of every suffix of two words or more, one row a word; 0 from where the suffix ends."""
    padded = np.concatenate((ids, np.zeros(LONGEST, np.uint64)))
    starts = np.nonzero((padded[:-1] != 0) & (padded[1:] != 0))[0]
    out = np.zeros((LONGEST, len(starts)), np.uint64)
    live = np.ones(len(starts), bool)
    for k in range(LONGEST):
        column = padded[starts + k]
        live &= column != 0
        out[k] = np.where(live, column, 0)
    return out


def _among(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(words), bool)
    return hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words


def leading(suffixes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """How many leading words route a suffix: those up to its first word that is not hot."""
    depth = np.full(suffixes.shape[1], LONGEST, np.int8)
    for k in reversed(range(LONGEST)):
        depth[~_among(suffixes[k], hot)] = k + 1
    return depth


def packed(suffixes: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """What owners need of some suffixes: bucket, kind, and words with their counts.

    Kind 0 has the suffixes, to the bucket that their leading words choose. Phrases of hot words alone would be spread
    over owners, so they are counted here and sent as phrases of two words (kind 2) or three (kind 3).
    """
    hashes, hashed = [], np.zeros(suffixes.shape[1], np.uint64)
    for k in range(LONGEST):
        hashed = mix(hashed ^ (suffixes[k] * _SALTS[k]))
        hashes.append(hashed)
    depth = leading(suffixes, hot)
    key = np.choose(depth - 1, hashes)
    yield from ((bucket, 0, body) for bucket, body in _merged(suffixes, hashes, key, buckets))
    for words in range(2, LONGEST):
        of_hot = depth > words
        phrases = suffixes[:, of_hot].copy()
        phrases[words:] = 0
        own = [h[of_hot] for h in hashes[:words]]
        own += [own[-1]] * (LONGEST - words)
        yield from ((bucket, words, body) for bucket, body in _merged(phrases, own, own[-1], buckets))


def _merged(suffixes: np.ndarray, hashes: list, key: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Suffixes by bucket, equal ones as one with their number. Those with equal leading words are together, so they
    also take little room once compressed."""
    order = np.zeros(suffixes.shape[1], np.uint64)
    for k in range(LONGEST):
        order = order << _WIDTHS[k] | hashes[k] >> np.uint64(64) - _WIDTHS[k]
    bucket = (key >> np.uint64(1)) % np.uint64(buckets)
    bits = np.uint64((buckets - 1).bit_length())
    if bits:
        order = order >> bits | bucket << np.uint64(64) - bits
    sort = np.argsort(order)
    suffixes, bucket = suffixes[:, sort], bucket[sort]
    new = np.ones(len(bucket), bool)
    new[1:] = (suffixes[:, 1:] != suffixes[:, :-1]).any(axis=0)
    first = np.nonzero(new)[0]
    counts = np.diff(np.append(first, len(bucket))).astype(np.uint64)
    suffixes, bucket = suffixes[:, first], bucket[first]
    edges = np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0] if len(bucket) else np.empty(0, np.int64)
    for start, end in zip(edges, np.append(edges[1:], len(bucket))):
        own = np.vstack((suffixes[:, start:end], counts[None, start:end]))
        yield int(bucket[start]), own.tobytes()


def _suffix_blocks(bitmap: np.ndarray, power: int, hot: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Ids] = {}
        parts, held = [], 0

        def sent() -> pa.RecordBatch:
            rows = list(packed(windows(np.concatenate(parts)), hot, buckets))
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([row[0] for row in rows], pa.int64()),
                    "kind": pa.array([row[1] for row in rows], pa.int32()),
                    "body": pa.array([row[2] for row in rows], pa.binary()),
                }
            )

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                words = tokens(text.as_py())
                if not words:
                    continue
                lang = lang.as_py()
                if lang not in known:
                    if len(known) > 64:
                        known.clear()
                    known[lang] = _Ids(lang, bitmap, power)
                ids = known[lang]
                # A document ends with a boundary.
                parts.append(np.fromiter(map(ids.__getitem__, [*words, b"\xff"]), np.uint64, len(words) + 1))
                held += len(words) + 1
                if held > BLOCK_TOKENS:
                    yield sent()
                    parts, held = [], 0
        if parts:
            yield sent()

    return run


def quicksorted(suffixes: np.ndarray, counts: np.ndarray, hot: np.ndarray, least: int = LEAST) -> Iterator[tuple]:
    """Phrases of the suffixes and how often they occur, by multikey three-way quicksort.

    All partitions of a depth are split in one pass: each has a pivot, the word at this depth of its middle pointer, and
    falls into pointers whose word is smaller, equal or larger. An equal partition is a phrase, its size the number of
    occurrences, and goes on with the next word; the others are split further at the same depth. A partition with fewer
    than `least` occurrences is abandoned, unless all words of its prefix are hot: the rest of that prefix's suffixes may
    be with other owners. Yields (depth, words, sizes) with one row of words for each phrase.
    """
    pointers = np.arange(suffixes.shape[1])
    starts = np.array([0] if len(pointers) else [], np.int64)
    shared = np.array([True] * len(starts))
    for depth in range(LONGEST):
        found, sizes = [], []
        next_pointers, next_lengths, next_shared = [], [], []
        while len(pointers):
            lengths = np.diff(np.append(starts, len(pointers)))
            part = np.repeat(np.arange(len(starts)), lengths)
            words = suffixes[depth, pointers]
            pivots = words[starts + lengths // 2]
            pivot = pivots[part]
            side = np.where(words < pivot, 0, np.where(words == pivot, 1, 2))
            # Places: partition by partition, smaller, equal, larger, each in the order they had.
            slot = part * 3 + side
            per_slot = np.bincount(slot, minlength=3 * len(starts))
            weight = np.bincount(slot, counts[pointers], minlength=3 * len(starts)).astype(np.int64)
            slot_start = np.cumsum(per_slot) - per_slot
            place = np.empty(len(pointers), np.int64)
            for which in range(3):
                own = side == which
                before = np.cumsum(own) - 1
                slots = slot[own]
                # The rank among this side's pointers, less those of earlier partitions.
                earlier = np.cumsum(per_slot[which::3]) - per_slot[which::3]
                place[own] = slot_start[slots] + before[own] - earlier[part[own]]
            ordered = np.empty_like(pointers)
            ordered[place] = pointers
            in_slot = np.empty_like(slot)
            in_slot[place] = slot
            # An equal partition of suffixes that have ended is no phrase.
            open_ = shared & _among(pivots, hot)
            phrase = (pivots != 0) & (open_ | (weight[1::3] >= least))
            if phrase.any():
                at = ordered[slot_start[1::3][phrase]]
                found.append(suffixes[: depth + 1, at])
                sizes.append(weight[1::3][phrase])
            goes_on = phrase & (depth + 1 < LONGEST)
            keep = np.zeros(3 * len(starts), bool)
            keep[1::3] = goes_on
            taken = keep[in_slot]
            next_pointers.append(ordered[taken])
            next_lengths.append(per_slot[1::3][goes_on])
            next_shared.append(open_[goes_on])
            stay = (per_slot > 0) & ((weight >= least) | np.repeat(shared, 3))
            stay[1::3] = False
            pointers = ordered[stay[in_slot]]
            lengths = per_slot[stay]
            starts = np.cumsum(lengths) - lengths
            shared = np.repeat(shared, 3)[stay]
        if found:
            yield depth + 1, np.concatenate(found, axis=1), np.concatenate(sizes)
        pointers = np.concatenate(next_pointers) if next_pointers else pointers
        lengths = np.concatenate(next_lengths) if next_lengths else np.empty(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        shared = np.concatenate(next_shared) if next_shared else np.empty(0, bool)


def _sorted_bucket(hot: np.ndarray, least: int):
    def run(blocks: pa.Table) -> pa.Table:
        tables = [pa.table({"phrase": pa.array([], pa.list_(pa.int64())), "f": pa.array([], pa.int64())})]
        of_kind: dict[int, list[np.ndarray]] = {}
        for kind, body in zip(blocks["kind"].to_pylist(), blocks["body"]):
            of_kind.setdefault(kind, []).append(np.frombuffer(body.as_py(), np.uint64).reshape(LONGEST + 1, -1))
        for kind, bodies in of_kind.items():
            everything = np.concatenate(bodies, axis=1)
            for depth, words, sizes in quicksorted(everything[:LONGEST], everything[LONGEST], hot, least):
                keep = (sizes >= least) & (depth > 1)
                if kind:
                    keep &= depth == kind
                elif depth < LONGEST:
                    keep &= ~np.all([_among(column, hot) for column in words], axis=0)
                words, sizes = words[:, keep], sizes[keep]
                ends = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * depth)
                flat = pa.array(np.ascontiguousarray(words.T).view(np.int64).ravel())
                tables.append(pa.table({"phrase": pa.ListArray.from_arrays(ends, flat), "f": pa.array(sizes)}))
        return pa.concat_tables(tables)

    return run


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """`phrase` (ids of 2 to LONGEST words) and `f` for all phrases with `least` occurrences or more."""
    frequent, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    bitmap, power = _filter(words, frequent)
    bound = max(HOT, total // HOT_WORDS)
    # No more than HOT_WORDS words can be above the bound.
    hottest = [row.id for row in words.where(f"f > {bound}").select("id").toLocalIterator()]
    hot = np.sort(np.array(hottest, np.int64).view(np.uint64))
    buckets = max(1, -(-total // SORTED))
    blocks = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        _suffix_blocks(bitmap, power, hot, buckets), "bucket long, kind int, body binary"
    )
    return stage(
        blocks.groupBy("bucket").applyInArrow(_sorted_bucket(hot, least), "phrase array<long>, f long"), "phrases"
    )


# --- scores


def _cuts(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each phrase: `phrase`, `a`, `l`, `r`, `score`."""
    known = phrases.unionByName(words.select(F.array("id").alias("phrase"), "f"))
    cut = phrases.select(
        "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")
    )
    first = known.select(F.col("phrase").alias("_first"), F.col("f").alias("l"))
    rest = known.select(F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    both = cut.join(first, F.expr("slice(phrase, 1, k)") == F.col("_first")).join(
        rest, F.expr("slice(phrase, k + 1, size(phrase) - k)") == F.col("_rest")
    )
    score = F.expr(
        f"cast(cast(a as decimal(28,0)) * {SCALE} div (cast(l as decimal(28,0)) + r) as bigint)"
    )
    lowest = both.withColumn("score", score).groupBy("phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c"))
    return lowest.select("phrase", "c.a", "c.l", "c.r", "c.score")


def _covered(phrases: DataFrame) -> DataFrame:
    """`phrase` and `most`: the occurrences of the most frequent longer phrase around it."""
    inner = F.expr(
        "filter(flatten(transform(sequence(2, size(phrase) - 1), n -> transform(sequence(1, size(phrase) - n + 1),"
        " i -> slice(phrase, i, n)))), p -> size(p) > 1)"
    )
    return (
        phrases.where("size(phrase) > 2")
        .select("f", F.explode(inner).alias("phrase"))
        .groupBy("phrase")
        .agg(F.max("f").alias("most"))
    )


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """The `best` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]`, and those into words `[^\\x20\\x09]+`. n
    counts the words of the language, a the occurrences of the phrase of 2 to 4 words, overlapping ones too, l and r those
    of the parts at the cut that scores lowest with floor(2000000 * a / (l + r)). Phrases with `least` occurrences count;
    one that lies in a longer such phrase with 80 % of its occurrences goes.

    Infrequent words are found first and end the suffixes of a text. Tasks send suffixes, copies as one, to owners chosen
    by the leading words, as many as it takes to get to a word that is not hot; an owner counts its phrases by multikey
    quicksort, and abandons what cannot reach `least`. A word is named by 64 bits in that.

    A null language is `und`, a null or empty text has no words; a word longer than others, however long, is a word.
    Repeated rows count as often as they stand there. Equal scores and counts are ordered by the bytes of the phrase. An
    empty table gives no rows. Further columns of `docs` are not read.
    """
    if least < 2:
        raise ValueError("A phrase is counted from 2 occurrences on.")
    words, sizes = word_counts(docs, least)
    phrases = phrase_counts(docs, words, least)
    cuts = _cuts(phrases, words).join(_covered(phrases), "phrase", "left")
    kept = stage(
        cuts.where(f"most is null or 100 * cast(most as decimal(20,0)) < {COVERED} * cast(a as decimal(20,0))").drop("most"),
        "collocations",
    )
    named = (
        kept.select("*", F.posexplode("phrase").alias("at", "id"))
        .join(words.select("lang", "word", "id"), "id")
        .groupBy("phrase", "lang", "a", "l", "r", "score")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda p: p.word), " ").alias("text"))
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("text")]
    # The first of each part, then the first of those: no task ranks a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(
        f"rank <= {best}"
    )
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"rank <= {best}")
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score"
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same rows in DuckDB SQL.
ORACLE = f"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
own as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
placed as (select lang, w, unnest(range(1, len(w) + 1)) as i from own),
grams as (
    select lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase
    from (select *, unnest(range(1, {LONGEST + 1})) as size from placed) where i + size - 1 <= len(w)),
counts as (select lang, size, phrase, count(*) as f from grams group by all),
totals as (select lang, cast(sum(f) as bigint) as n from counts where size = 1 group by lang),
frequent as (select *, string_split(phrase, ' ') as w from counts where f >= {LEAST}),
cuts as (
    select c.lang, c.phrase, c.w, c.f as a, k, l.f as l, r.f as r, {SCALE}::hugeint * c.f // (l.f + r.f) as score
    from (select *, unnest(range(1, size)) as k from frequent) c
    join frequent l on l.lang = c.lang and l.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
    join frequent r on r.lang = c.lang and r.phrase = array_to_string(list_slice(c.w, k + 1, c.size), ' ')),
lowest as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_phrases as (
    select lang, f, array_to_string(list_slice(w, i, i + part - 1), ' ') as phrase
    from (select *, unnest(range(1, size - part + 2)) as i
          from (select *, unnest(range(2, size)) as part from frequent))),
covered as (select lang, phrase, max(f) as most from inner_phrases group by lang, phrase),
ranked as (
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n,
        cast(score as bigint) as score
    from lowest left join covered using (lang, phrase) join totals using (lang)
    where most is null or 100 * most::hugeint < {COVERED} * a::hugeint)
select * from ranked where rank <= {BEST}"""
