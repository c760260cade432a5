"""Language-model scores: a causal self-attention model on subword ids beside a word count model."""

from __future__ import annotations

import base64
import io
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stage

#: A public byte-pair vocabulary (base64 token, rank). A parameter, so any file of that form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The most frequent subwords have a class of their own; the others share classes of about equal weight.
OWN, SHARED = 447, 64
#: Classes are predicted in two steps: a group of so many neighbouring classes, then one of them.
SPAN = 16
#: Context window, and how far one window is from the next: each token is scored in one of them only.
CONTEXT, STRIDE = 32, 24
WIDTH, INNER = 32, 64
BATCH, RATE = 96, 0.006
#: Steps that training takes at least: few texts are passed over again until then, more texts once.
STEPS = 220
#: Blocks are dealt into so many rounds. Those of one round learn side by side and their weights are averaged.
ROUNDS = 4
#: Averages of tasks' weights are averaged in so many groups before the driver gets them.
GROUPS = 16
#: Text of one block of documents: its words are numbered and counted together.
BLOCK_BYTES, BLOCK_DOCS = 8_000_000, 4096
#: Windows that are computed at once.
WINDOWS = 256
#: Words whose places are laid out at once; a longer document is laid out alone.
LAID_OUT = 100_000
#: Logits beyond this, either way, need the largest of their row taken off before the exponential.
LARGEST = 60
#: Longer words are cut for the tokenizer, whose time grows faster than their length.
PIECE = 64

END = 0


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def opens(ranks: dict[bytes, int]) -> np.ndarray:
    """Which ids begin with a blank, and so open a word."""
    out = np.zeros(max(ranks.values()) + 1, bool)
    out[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
    return out


class Subwords:
    """Subword ids of single words, each after a blank."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.size = max(ranks.values()) + 1
        pieces = r" [^ ]{0,%d}|[^ ]{1,%d}" % (PIECE - 1, PIECE)
        self._encoding = tiktoken.Encoding("subwords", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
        self._opens = opens(ranks)

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has. Words have no blanks in them, so each
        begins with the only one of its ids whose token begins with a blank."""
        ids = np.array(self._encoding.encode_ordinary("".join([" " + word for word in words])), np.int32)
        return ids, np.diff(np.flatnonzero(self._opens[ids]), append=len(ids))


# --- the attention model ---------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Predicts the class of the next subword from the classes before it; within its class a subword has its share of
    the training counts."""

    classes: np.ndarray  # of each subword id
    within: np.ndarray  # log10 share of each subword id in its class
    group_follows: np.ndarray  # log odds of a group after a class, from counts: [class, group]
    class_follows: np.ndarray  # log odds of a class in its group after a class: [group, class before, class in it]
    weights: dict[str, np.ndarray]


def assign_classes(
    counts: np.ndarray, opens: np.ndarray | None = None, own: int = OWN, shared: int = SHARED
) -> tuple[np.ndarray, np.ndarray]:
    """Class and log10 share within it for each subword id. Class 0 is the end of a text. Shared classes hold either
    subwords that open a word or such that do not, and subwords of like frequency."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    classes = np.empty(len(counts), np.int32)
    classes[order[:own]] = np.arange(1, min(own, len(counts)) + 1)
    rest = order[own:]
    smoothed = counts.astype(np.float64) + 0.5
    if len(rest):
        if opens is not None:
            rest = rest[np.argsort(opens[rest], kind="stable")]
        shares = (np.cumsum(smoothed[rest]) - smoothed[rest] / 2) / smoothed[rest].sum()
        classes[rest] = own + 1 + np.minimum(shared - 1, (shares * shared).astype(np.int32))
    totals = np.bincount(classes, smoothed, own + shared + 1)
    return classes, np.log10(smoothed / totals[classes])


def new_weights(n_classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    d, groups = WIDTH, n_classes // SPAN
    return {
        "group": normal(d, groups, scale=0.02), "group_bias": np.zeros(groups, np.float32),
        "token": normal(n_classes, d, scale=0.3), "place": normal(CONTEXT, d, scale=0.1),
        "q": normal(d, d, scale=d**-0.5), "k": normal(d, d, scale=d**-0.5), "v": normal(d, d, scale=d**-0.5),
        "o": normal(d, d, scale=d**-0.5), "w1": normal(d, INNER, scale=d**-0.5), "b1": np.zeros(INNER, np.float32),
        "w2": normal(INNER, d, scale=INNER**-0.5), "out": normal(groups, d, SPAN, scale=0.02),
        "bias": np.zeros((groups, SPAN), np.float32),
    }


def _normalised(x: np.ndarray) -> np.ndarray:
    """The sums by which rows, turned into exponentials in place, are divided for their softmax. The largest logit of each row is taken
    off only where the logits are too far apart for the exponentials themselves."""
    if x.size and (x.max() > LARGEST or x.min() < -LARGEST):
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[-1], x.dtype)


def _joint(w: dict[str, np.ndarray]) -> np.ndarray:
    """Of embeddings, the queries, to be held against embeddings themselves, and the values as they are added: the
    products of the matrices that always follow one another."""
    return np.concatenate((w["q"] @ w["k"].T * WIDTH**-0.5, w["v"] @ w["o"]), axis=1)


def forward(w: dict[str, np.ndarray], inputs: np.ndarray, since: int = 0) -> dict[str, np.ndarray]:
    """Masked attention over windows of class ids (rows). `hidden` is given for the places from `since` on."""
    rows, length = inputs.shape
    d, flat = WIDTH, inputs.ravel()

    def placed(table: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """What places have of their class, plus what they have of their position."""
        out = table.take(flat, axis=0).reshape(rows, length, d)
        out += positions
        return out

    joint, positions = _joint(w), w["place"][:length]
    x = placed(w["token"], positions)
    q = placed(w["token"] @ joint[:, :d], positions @ joint[:, :d])[:, since:]
    v = placed(w["token"] @ joint[:, d:], positions @ joint[:, d:])
    late = x[:, since:]
    weights = q @ x.transpose(0, 2, 1)
    # Places after a token's own are masked.
    seen = np.arange(since, length)[:, None] >= np.arange(length)
    if weights.size and (weights.max() > LARGEST or weights.min() < -LARGEST):
        weights[:, ~seen] = -np.inf
        weights -= weights.max(-1, keepdims=True)
    np.exp(weights, out=weights)
    weights *= seen.astype(x.dtype)
    weights *= (1 / (weights.reshape(-1, length) @ np.ones(length, x.dtype))).reshape(rows, -1, 1)
    mixed = weights @ v
    joined = mixed + late
    inner = joined.reshape(-1, d) @ w["w1"]
    inner += w["b1"]
    np.maximum(inner, 0, out=inner)
    hidden = (inner @ w["w2"]).reshape(joined.shape)
    hidden += joined
    return {
        "x": x, "q": q, "v": v, "weights": weights, "mixed": mixed, "joined": joined, "inner": inner, "hidden": hidden,
    }


def _by_group(group: np.ndarray, groups: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts equal groups together, and each group that occurs with its range in that order."""
    order = np.argsort(group.astype(np.int16), kind="stable")
    edges = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=groups)))).tolist()
    return order, [(g, edges[g], edges[g + 1]) for g in range(groups) if edges[g] < edges[g + 1]]


def _class_logits(
    model: Model, rows: np.ndarray, before: np.ndarray, group: np.ndarray, ranges: list[tuple[int, int, int]]
) -> np.ndarray:
    """Logits of the classes in the group of each place; places are ordered by group."""
    w = model.weights
    follows = model.class_follows.reshape(-1, SPAN)
    logits = follows.take(group * np.int64(model.class_follows.shape[1]) + before, axis=0)
    logits += w["bias"].take(group, axis=0)
    for number, start, end in ranges:
        logits[start:end] += rows[start:end] @ w["out"][number]
    return logits


def _chosen(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probabilities of one entry of each row; the logits are used up."""
    if logits.size and logits.max() > 80:
        np.minimum(logits, 80, out=logits)
    chosen = logits.ravel().take(np.arange(len(at)) * logits.shape[1] + at).astype(np.float64)
    np.exp(logits, out=logits)
    return chosen - np.log((logits @ np.ones(logits.shape[1], logits.dtype)).astype(np.float64))


def log_probabilities(model: Model, hidden: np.ndarray, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of the target classes; all arguments flat."""
    w = model.weights
    group, within = targets // SPAN, targets % SPAN
    logits = hidden @ w["group"]
    logits += (model.group_follows + w["group_bias"]).take(inputs, axis=0)
    out = _chosen(logits, group)
    order, ranges = _by_group(group, len(w["out"]))
    logits = _class_logits(model, hidden.take(order, axis=0), inputs.take(order), group.take(order), ranges)
    out[order] += _chosen(logits, within.take(order))
    return out


def gradients(model: Model, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[float, dict]:
    """Mean loss of the valid places, and its derivatives."""
    w, f = model.weights, forward(model.weights, inputs)
    d = WIDTH
    flat, inner, joined = f["hidden"].reshape(-1, d), f["inner"], f["joined"].reshape(-1, d)
    before, ok = inputs.ravel(), valid.ravel()
    at, group, within = np.arange(targets.size), targets.ravel() // SPAN, targets.ravel() % SPAN
    count = max(1, int(ok.sum()))
    share = (ok / count).astype(flat.dtype)
    p = flat @ w["group"]
    p += (model.group_follows + w["group_bias"]).take(before, axis=0)
    sums = _normalised(p)
    loss = -float((np.log(p[at, group] / sums + 1e-30) * ok).sum() / count)
    p *= (share / sums)[:, None]
    p[at, group] -= share
    ones = np.ones(len(at), flat.dtype)
    g = {"group": flat.T @ p, "group_bias": ones @ p}
    by_flat = p @ w["group"].T
    # Of each place, the classes of its target's group.
    order, ranges = _by_group(group, len(w["out"]))
    rows, share, within, group = flat.take(order, axis=0), share.take(order), within.take(order), group.take(order)
    p = _class_logits(model, rows, before.take(order), group, ranges)
    sums = _normalised(p)
    loss -= float((np.log(p[at, within] / sums + 1e-30) * ok.take(order)).sum() / count)
    p *= (share / sums)[:, None]
    p[at, within] -= share
    g["out"], g["bias"] = np.zeros_like(w["out"]), np.zeros_like(w["bias"])
    by_rows = np.empty_like(rows)
    for number, start, end in ranges:
        own = p[start:end]
        np.matmul(rows[start:end].T, own, out=g["out"][number])
        np.matmul(ones[start:end], own, out=g["bias"][number])
        np.matmul(own, w["out"][number].T, out=by_rows[start:end])
    back = np.empty_like(order)
    back[order] = at
    by_flat += by_rows.take(back, axis=0)
    by_inner = by_flat @ w["w2"].T
    by_inner *= inner > 0
    g["w2"] = inner.T @ by_flat
    g["w1"] = joined.T @ by_inner
    g["b1"] = ones @ by_inner
    by_joined = by_inner @ w["w1"].T
    by_joined += by_flat
    x, q, v, weights = f["x"], f["q"], f["v"], f["weights"]
    by_mixed = by_joined.reshape(f["mixed"].shape)
    by_both = np.empty((*x.shape[:2], 2 * d), x.dtype)
    np.matmul(weights.transpose(0, 2, 1), by_mixed, out=by_both[:, :, d:])
    by_weights = by_mixed @ v.transpose(0, 2, 1)
    by_weights -= np.einsum("bij,bij->bi", by_mixed, f["mixed"])[:, :, None]
    by_weights *= weights
    np.matmul(by_weights, x, out=by_both[:, :, :d])
    by_both = by_both.reshape(-1, 2 * d)
    by_joint = x.reshape(-1, d).T @ by_both
    by_query, by_value = by_joint[:, :d] * d**-0.5, by_joint[:, d:]
    g["q"], g["k"] = by_query @ w["k"], by_query.T @ w["q"]
    g["v"], g["o"] = by_value @ w["o"].T, w["v"].T @ by_value
    by_x = by_both @ _joint(w).T
    by_x += by_joined
    by_x += (by_weights.transpose(0, 2, 1) @ q).reshape(-1, d)
    g["place"] = np.zeros_like(w["place"])
    g["place"][: inputs.shape[1]] = by_x.reshape(*inputs.shape, d).sum(0)
    g["token"] = np.zeros_like(w["token"])
    order = np.argsort(before.astype(np.int16), kind="stable")
    met = before.take(order)
    first = np.flatnonzero(np.concatenate(([True], met[1:] != met[:-1])))
    g["token"][met[first]] = np.add.reduceat(by_x.take(order, axis=0), first)
    return loss, g


def padded(classes: np.ndarray) -> int:
    """The number of classes, filled up to whole groups."""
    return -(-(int(classes.max()) + 1) // SPAN) * SPAN


def pairs_of(stream: np.ndarray, n: int) -> np.ndarray:
    """How often a class follows another, in texts one after the other, as [class before * n + class]."""
    before, out = _before(stream), np.zeros(n * n, np.int64)
    for at in range(0, len(stream), LAID_OUT):
        part = slice(at, at + LAID_OUT)
        np.add.at(out, before[part] * np.int64(n) + stream[part], 1)
    return out


def untrained(pairs: np.ndarray, classes: np.ndarray, within: np.ndarray, seed: int = 7) -> Model:
    """A model that knows which class follows which, with weights as they are drawn."""
    n = padded(classes)
    pairs = pairs.reshape(n, n) + 0.02
    # A class that was met a few times leans on how frequent the next class is at all.
    pairs += 20 * pairs.sum(0) / pairs.sum()
    in_groups = pairs.reshape(n, -1, SPAN)
    group_follows = np.log(in_groups.sum(2) / pairs.sum(1, keepdims=True)).astype(np.float32)
    class_follows = np.log(in_groups / in_groups.sum(2, keepdims=True)).transpose(1, 0, 2).astype(np.float32)
    weights = new_weights(n, np.random.default_rng(seed))
    return Model(classes, within, group_follows, np.ascontiguousarray(class_follows), weights)


def learn(
    model: Model, stream: np.ndarray, passes: int = 1, seed: int = 7, since: float = 0.0, until: float = 1.0
) -> dict[str, np.ndarray]:
    """The weights after Adam has gone over all windows of the texts in `stream`, in random order, so many times.
    `since` and `until` say which part of the whole training this is; the rate falls over the whole."""
    names = list(model.weights)
    # All weights are one array, of which `weights` has views, so that a step is a few operations.
    value = np.concatenate([model.weights[name].ravel() for name in names])
    cuts = np.cumsum([model.weights[name].size for name in names])[:-1]
    weights = {name: part.reshape(model.weights[name].shape) for name, part in zip(names, np.split(value, cuts))}
    now = Model(model.classes, model.within, model.group_follows, model.class_follows, weights)
    before, (starts, sizes) = _before(stream), _cut_windows(stream)
    first, second = np.zeros_like(value), np.zeros_like(value)
    rng, step, steps = np.random.default_rng(seed), 0, passes * -(-len(starts) // BATCH)
    for _ in range(passes):
        order = rng.permutation(len(starts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            _, by_name = gradients(now, *_filled(stream, before, starts[pick], sizes[pick]))
            g = np.concatenate([by_name[name].ravel() for name in names])
            step += 1
            rate = RATE * min(1.0, step / 20) * (1 - since - (until - since) * step / (steps + 1))
            first *= 0.9
            first += 0.1 * g
            second *= 0.99
            np.multiply(g, g, out=g)
            g *= 0.01
            second += g
            size = np.sqrt(second * (1 / (1 - 0.99**step)))
            size += 1e-8
            np.divide(first, size, out=size)
            size *= rate / (1 - 0.9**step)
            value -= size
    return weights


def passes_for(places: int) -> int:
    """How often texts of so many places in all are passed over."""
    return max(1, -(-STEPS * BATCH * CONTEXT // max(1, places)))


def fit(streams: list[np.ndarray], classes: np.ndarray, within: np.ndarray, seed: int = 7) -> Model:
    """A model trained on streams of class ids, each ending in END, as one block. Without streams the model stays as
    it was drawn, and predicts every class about alike."""
    stream = np.concatenate([np.empty(0, np.int32), *streams])
    model = untrained(pairs_of(stream, padded(classes)), classes, within, seed)
    if len(stream):
        model.weights = learn(model, stream, passes_for(len(stream)), seed)
    return model


def _cut_windows(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows without overlap begin, of texts one after the other with END at the end of each, and how many
    places each has. No window holds places of two texts."""
    ends = np.flatnonzero(stream == END) + 1
    if not len(ends) or ends[-1] < len(stream):
        ends = np.append(ends, len(stream))
    starts = np.concatenate(([0], ends[:-1]))
    count = -(-(ends - starts) // CONTEXT)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(starts, count) + number * CONTEXT
    return first, np.minimum(np.repeat(ends, count) - first, CONTEXT)


def _before(stream: np.ndarray) -> np.ndarray:
    """The class before each place; before the first one, an end."""
    return np.concatenate(([END], stream[:-1])).astype(np.int32)


def _filled(
    stream: np.ndarray, before: np.ndarray, first: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inputs and targets of some windows, and which places are real."""
    valid = np.arange(CONTEXT) < sizes[:, None]
    index = np.minimum(first[:, None] + np.arange(CONTEXT), max(0, len(stream) - 1))
    return np.where(valid, before[index], END), np.where(valid, stream[index], END), valid


def windows(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows for training, of texts one after the other, END at the end of each: inputs, targets, which places
    are real."""
    return _filled(stream, _before(stream), *_cut_windows(stream))


def score_streams(model: Model, stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of the classes of each text: texts lie in `stream` one after the other, END at the end of
    each. Windows overlap: but for a text's first window, the first CONTEXT - STRIDE places of one are context."""
    before = _before(stream)
    before[starts] = END
    places = np.arange(CONTEXT)
    found = np.zeros(len(stream))

    def run(text: np.ndarray, begin: np.ndarray, since: int) -> None:
        # Windows that end before their text does have no places to leave out.
        whole = begin + CONTEXT <= (starts + lengths)[text]
        for chosen in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for at in range(0, len(chosen), WINDOWS):
                own = chosen[at : at + WINDOWS]
                index = begin[own][:, None] + places
                real = None if whole[own[0]] else index[:, since:] < (starts + lengths)[text[own]][:, None]
                np.minimum(index, len(stream) - 1, out=index)
                inputs = before.take(index)
                hidden = forward(model.weights, inputs, since)["hidden"]
                index, inputs = index[:, since:], inputs[:, since:]
                if real is not None:
                    index, inputs, hidden = index[real], inputs[real], hidden[real]
                index = index.ravel()
                found[index] = log_probabilities(model, hidden.reshape(-1, WIDTH), inputs.ravel(), stream.take(index))

    run(np.arange(len(starts)), starts, 0)
    more = np.maximum(0, -(-(lengths - CONTEXT) // STRIDE))
    text = np.repeat(np.arange(len(starts)), more)
    number = np.arange(len(text)) - np.repeat(np.cumsum(more) - more, more) + 1
    run(text, starts[text] + number * STRIDE, CONTEXT - STRIDE)
    return (np.add.reduceat(found, starts) if len(starts) else np.zeros(0)) / math.log(10)


# --- over a table ----------------------------------------------------------------------------------------------------

_BLOCK = (
    "block long, doc_ids array<{id}>, held_out array<boolean>, lengths binary, codes binary, "
    "vocabulary array<struct<word:string,at:int,n:long>>"
)
_CUT = ", subwords binary"


def _numbers() -> defaultdict[bytes, int]:
    """Numbers words in the order in which they are looked up."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def _blocks(docs: DataFrame, ranks=None) -> DataFrame:
    """Documents in blocks: their words as numbers, and each word with its count in the block's training documents. With
    a broadcast vocabulary also the subwords of each word, so that later steps need not cut it again."""
    schema = _BLOCK.format(id=docs.schema["doc_id"].dataType.simpleString()) + (_CUT if ranks else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, held, lengths, codes, trained, size = [], [], [], [], [], 0
        subwords = Subwords(ranks.value) if ranks else None
        numbers = _numbers()

        def block() -> pa.RecordBatch:
            all_codes = np.concatenate(codes) if codes else np.empty(0, np.int32)
            train = np.concatenate(trained) if trained else np.empty(0, np.int32)
            counts = np.bincount(train, minlength=len(numbers))
            words = [w.decode() for w in numbers]
            vocabulary = pa.StructArray.from_arrays(
                [
                    pa.array(words, pa.string()),
                    pa.array(np.arange(len(numbers), dtype=np.int32)),
                    pa.array(counts.astype(np.int64)),
                ],
                names=["word", "at", "n"],
            )
            ends = pa.array([0, len(numbers)], pa.int32())
            columns = {
                "block": pa.array([number], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids)),
                "held_out": pa.array([held], pa.list_(pa.bool_())),
                "lengths": pa.array([np.array(lengths, np.int32).tobytes()], pa.binary()),
                "codes": pa.array([all_codes.tobytes()], pa.binary()),
                "vocabulary": pa.ListArray.from_arrays(ends, vocabulary),
            }
            if subwords:
                flat, sizes = (x.astype(np.min_scalar_type(x.max(initial=0))) for x in subwords.flat(words))
                columns["subwords"] = pa.array([_packed({"flat": flat, "sizes": sizes})], pa.binary())
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            chars = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            for at in range(batch.num_rows):
                words = (texts[at].as_py() or b"").lower().split()
                own = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                ids.append(batch.column(0).slice(at, 1))
                held.append(batch.column(1)[at].as_py())
                lengths.append(len(own))
                codes.append(own)
                if not held[-1]:
                    trained.append(own)
                size += chars[at]
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield block()
                    ids, held, lengths, codes, trained, size = [], [], [], [], [], 0
                    numbers, number = _numbers(), number + 1
        if ids:
            yield block()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _subword_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """How often each subword id occurs in all training documents. The driver gets a row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                flat, sizes = _cut(batch, at, None)
                times = np.repeat(np.asarray(batch.column("n")[at].values), sizes)
                sums += np.bincount(flat, times, size).astype(np.int64)
        found = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["id", "n"])

    rows = blocks.select("subwords", F.col("vocabulary.n").alias("n")).mapInArrow(run, "id long, n long")
    counts = np.zeros(size, np.int64)
    for row in rows.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


def _cut(batch: pa.RecordBatch | pa.Table, at: int, subwords: Subwords | None) -> tuple[np.ndarray, np.ndarray]:
    """The subwords of a block's words one after the other and how many each word has: as staged, or else cut now."""
    if "subwords" in batch.schema.names:
        packed = _unpacked(batch.column("subwords")[at].as_py())
        return packed["flat"].astype(np.int32), packed["sizes"].astype(np.int64)
    return subwords.flat(batch.column("words")[at].as_py())


def _places(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """The subwords of a block's words and, at the end, of the end of a text; where the subwords of its texts lie in
    them, text by text; and how many each text has."""
    codes = np.insert(codes, np.cumsum(lengths), len(sizes))
    first = np.cumsum(lengths + 1) - (lengths + 1)
    flat, sizes = np.append(flat, 0), np.append(sizes, 1)
    offsets = np.cumsum(sizes) - sizes
    times = sizes[codes]
    place = np.repeat(offsets[codes] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    return flat, place, np.add.reduceat(times, first)


def _slices(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Runs of documents of about LAID_OUT words, and where their words are."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + LAID_OUT, "right")))
        yield slice(start, end), slice(before, int(ends[end - 1]))
        start = end


def _streams(
    batches: Iterator[pa.RecordBatch], classes: np.ndarray, subwords: Subwords | None
) -> Iterator[tuple[int, np.ndarray]]:
    """Of each block, its number and the classes of its training documents, END at the end of each."""
    for batch in batches:
        for at in range(batch.num_rows):
            held = np.array(batch.column("held_out")[at].as_py(), bool)
            lengths = np.frombuffer(batch.column("lengths")[at].as_py(), np.int32).astype(np.int64)
            codes = np.frombuffer(batch.column("codes")[at].as_py(), np.int32)
            codes = codes[np.repeat(~held, lengths)]
            lengths = lengths[~held]
            if not len(lengths):
                continue
            cut, parts = _cut(batch, at, subwords), []
            for docs, words in _slices(lengths):
                flat, place, _ = _places(*cut, codes[words], lengths[docs])
                by_flat = classes[flat].astype(np.int32)
                by_flat[-1] = END
                parts.append(by_flat[place])
            yield batch.column("block")[at].as_py(), np.concatenate(parts)


def _packed(weights: dict[str, np.ndarray]) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **weights)
    return buffer.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return {name: arrays[name] for name in arrays.files}


class _Average:
    """A mean of weights by places."""

    def __init__(self):
        self.sums: dict[str, np.ndarray] = {}
        self.places = 0

    def add(self, weights: dict[str, np.ndarray], places: int) -> None:
        for name, value in weights.items():
            self.sums[name] = self.sums.get(name, 0.0) + value.astype(np.float64) * places
        self.places += places

    def weights(self) -> dict[str, np.ndarray]:
        return {name: (value / self.places).astype(np.float32) for name, value in self.sums.items()}


_WEIGHTS = "part long, weights binary, places long"


def _row(part: int, average: _Average) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([_packed(average.weights())], pa.binary()), pa.array([average.places])],
        names=["part", "weights", "places"],
    )


def _pair_counts(texts: DataFrame, classes: np.ndarray, ranks=None) -> np.ndarray:
    """How often a class follows another in all training documents. The driver gets a row for each pair at most."""
    n = padded(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n * n, np.int64)
        for _, stream in _streams(batches, classes, Subwords(ranks.value) if ranks else None):
            sums += pairs_of(stream, n)
        found = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["pair", "n"])

    rows = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(n * n, np.int64)
    pairs[np.asarray(rows["pair"])] = np.asarray(rows["n"])
    return pairs


def _round(texts: DataFrame, model: Model, ranks, passes: int, number: int) -> dict[str, np.ndarray]:
    """The weights after one round: its blocks each learn from the same weights, and the results are averaged."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, average = sent.value, _Average()
        for block, stream in _streams(batches, model.classes, Subwords(ranks.value) if ranks else None):
            since, until = number / ROUNDS, (number + 1) / ROUNDS
            average.add(learn(model, stream, passes, block, since, until), len(stream))
        if average.places:
            yield _row(TaskContext.get().partitionId() % GROUPS, average)

    def merge(table: pa.Table) -> pa.Table:
        average = _Average()
        for weights, places in zip(table["weights"], table["places"]):
            average.add(_unpacked(weights.as_py()), places.as_py())
        return pa.Table.from_batches([_row(table["part"][0].as_py(), average)])

    own = texts.where(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == number)
    whole = _Average()
    for row in own.mapInArrow(run, _WEIGHTS).groupBy("part").applyInArrow(merge, _WEIGHTS).collect():
        whole.add(_unpacked(row.weights), row.places)
    sent.unpersist()
    return whole.weights() if whole.places else model.weights


def train(blocks: DataFrame, ranks: dict[bytes, int]) -> Model:
    """The attention model. Every training document of every block is learned from."""
    opening = opens(ranks)
    classes, within = assign_classes(_subword_counts(blocks, len(opening)), opening)
    texts = blocks.select("block", "held_out", "lengths", "codes", "subwords")
    pairs = _pair_counts(texts, classes)
    model = untrained(pairs, classes, within)
    places = int(pairs.sum())
    for number in range(ROUNDS if places else 0):
        model.weights = _round(texts, model, None, passes_for(places), number)
    return model


def score(docs: DataFrame, held_out: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """Scores of all documents by models that have learned from those that are not `held_out`.

    doc_id, held_out, n_tokens (words and one end), n_known (tokens met in training), train_tokens, base_score (sum of
    log10 of add-one word frequencies), score (log10 probability of the text by the attention model) and n_subwords.

    Words are counted in blocks of documents, the blocks' vocabularies are added up, and each block gets the counts of
    its words back; so a frequent word is a row for each block, not for each document. The attention model counts which
    class follows which in all training documents, and trains on all windows of them: blocks of one round learn side by
    side from the same weights, whose average the next round begins with. Null
    and empty texts consist of their end. Rows are scored one by one, repeated rows alike. Without training documents
    nothing is known: base_score is 0 and the attention model is as it was drawn.
    """
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    blocks = stage(_blocks(rows, ranks), "lm-blocks")
    words = blocks.select("block", F.inline("vocabulary"))
    by_word = Window.partitionBy("word")
    counted = stage(
        words.withColumn("c", F.sum("n").over(by_word))
        .withColumn("first", F.row_number().over(by_word.orderBy("block")) == 1)
        .where("c > 0")
        .select("block", "at", "c", "first"),
        "lm-counts",
    )
    n_words, n_distinct = counted.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    trained = blocks.agg(F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()[0] or 0
    n_total, v_total = n_words + trained, n_distinct + (trained > 0)
    sent = docs.sparkSession.sparkContext.broadcast(train(blocks, ranks.value))

    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        parts = [
            _scored(row, counts, sent.value, n_total, v_total, trained)
            for row in (block.slice(at, 1) for at in range(block.num_rows))
        ]
        return pa.concat_tables(parts)

    # The words themselves do not travel again.
    texts = blocks.select("block", "doc_ids", "held_out", "lengths", "codes", "subwords")
    return (
        texts.groupBy("block")
        .cogroup(counted.select("block", "at", "c").groupBy("block"))
        .applyInArrow(
            run,
            f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
            "score double, n_subwords long",
        )
    )


def _scored(block: pa.Table, counts: pa.Table, model: Model, n: int, v: int, ends: int) -> pa.Table:
    lengths = np.frombuffer(block["lengths"][0].as_py(), np.int32).astype(np.int64)
    codes = np.frombuffer(block["codes"][0].as_py(), np.int32)
    flat, sizes = _cut(block, 0, None)
    # The end is one more word of the block, after each document's own.
    known = np.zeros(len(sizes) + 1, np.int64)
    known[np.asarray(counts["at"])] = np.asarray(counts["c"])
    known[-1] = ends
    logs = np.log10(known + 1.0)
    n_tokens = lengths + 1
    parts = []
    for own, words in _slices(lengths):
        first = np.cumsum(n_tokens[own]) - n_tokens[own]
        by_flat, place, n_subwords = _places(flat, sizes, codes[words], lengths[own])
        at = np.insert(codes[words], np.cumsum(lengths[own]), len(sizes))
        base = np.add.reduceat(logs[at], first) - n_tokens[own] * math.log10(n + v + 1)
        n_known = np.add.reduceat((known > 0)[at].astype(np.int64), first)
        classes, within = model.classes[by_flat], model.within[by_flat]
        classes[-1], within[-1] = END, 0.0
        starts = np.cumsum(n_subwords) - n_subwords
        total = score_streams(model, classes[place], starts, n_subwords) + np.add.reduceat(within[place], starts)
        parts.append((n_known, base, total, n_subwords))
    n_known, base, total, n_subwords = (np.concatenate(x) for x in zip(*parts))
    count = len(lengths)
    return pa.table(
        {
            "doc_id": block["doc_ids"].combine_chunks().flatten(),
            "held_out": block["held_out"].combine_chunks().flatten(),
            "n_tokens": n_tokens,
            "n_known": n_known,
            "train_tokens": np.full(count, n, np.int64),
            "base_score": base,
            "score": total,
            "n_subwords": n_subwords,
        }
    )
