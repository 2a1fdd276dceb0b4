"""Masked pseudo-likelihood: a bidirectional window network scores documents.

Every token is predicted from the words on both sides. Frequent words are classes of
their own; all others fall into hashed classes, whose words share the probability by
their counts in the corpus. Classes grow as the root of the distinct words. The softmax is
hierarchical: a group of classes, then a class in the group, each normalised exactly, so a
token costs twice the root of the classes. Documents are dealt by a hash into shards,
whose number the corpus alone decides; each shard trains from the same start, and the
weights are averaged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage

OFFSETS = (-2, -1, 1, 2)
EDGE = max(abs(o) for o in OFFSETS)
CLASSES = 1024  # at least: three in four for a frequent word each, the others hashed, the last for the edge of a text
HIDDEN = 16
ROUNDS = 2  # over all documents; each token is predicted in one of them
RATE = 0.2
STEPS = 256, 4096  # the fewest and the most tokens of a training step
STEPS_OF_SHARD = 256  # the steps that a shard should have at least, while steps are large enough
CHUNK = 65_536  # tokens scored at once
BLOCK = 1024  # tokens weighed at once
ALONE = 24  # a group of more tokens has products of its own
SUMMED = 8  # a class seen more often in a step is summed alone
FILLED = 0.7  # of the places that groups weighed together have, a group fills more than this share
COUNTED = 500_000  # distinct words that a task counts before it hands them on
SHARD_TOKENS = 4_000_000  # the corpus has a shard for so many

CACHED = 50_000  # words whose counts every task holds; those of the others are joined
NONE = -30.0  # the bias of a class that is never a target
LARGE = 60.0  # scores that cannot exceed this have exponentials that neither overflow nor vanish


def groups(classes: int) -> tuple[int, int]:
    """How many groups the classes have, and how many classes a group; class c is number c % m of group c // m."""
    g = math.isqrt(classes - 1) + 1
    return g, -(-classes // g)


def sizes(classes: int) -> list[tuple[int, ...]]:
    """Embeddings by offset; weights of groups; weights of the classes of each group. The last row of weights is the bias."""
    g, m = groups(classes)
    return [(len(OFFSETS), classes, HIDDEN), (HIDDEN + 1, g), (g, HIDDEN + 1, m)]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, cut and lowered as ``words_of`` does, and how many each text has."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = pieces.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty piece
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy())])
    return words.filter(real).cast(pa.binary()), np.diff(before[ends])


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, words.to_numpy(zero_copy_only=False).tolist()), np.int64, len(words))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    waiting = 0

    def merged() -> pa.Table:
        total = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return total.select(["word", "n_sum"]).rename_columns(["word", "n"])

    def rows(counts: pa.Table) -> Iterator[pa.RecordBatch]:
        for part in counts.to_batches(max_chunksize=100_000):
            yield part.append_column("hash", pa.array(_hashes(part.column("word"))))

    for batch in batches:
        for piece in _slices(batch, "text"):
            found = pc.value_counts(_split(piece.column("text"))[0])
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            waiting += len(found)
            if waiting > 2 * COUNTED:
                held = [merged()]
                waiting = len(held[0])
                if waiting > COUNTED:
                    yield from rows(held[0])
                    held, waiting = [], 0
    if held:
        yield from rows(merged())


class Vocabulary:
    """Classes of words, and the log probability of a word within its class.

    That is the log of the word's count less that of its class. ``within`` has the latter
    for every class; ``logs`` the former of the cached words, those of ``cached_from``
    occurrences or more.
    """

    def __init__(self, size: int, frequent: list[tuple[bytes, int]], hashed: dict[int, int], cached: list, cached_from: int):
        self.size, self.frequent, self.cached_from = size, size * 3 // 4, cached_from
        self.classes = {w: i for i, (w, _) in enumerate(frequent)}
        own = len(self.classes)
        shared = [(w, n, h) for w, n, h in cached if w not in self.classes]
        self.classes |= {w: self.hashed(h) for w, _, h in shared}
        # Words by number: those with a class of their own, then the cached ones, then one for all others.
        self.words = pa.array(list(self.classes), pa.binary())
        self.class_of = np.array([*self.classes.values(), 0], np.int32)
        self.log_of = np.array([0.0] * own + [math.log(n) for _, n, _ in shared] + [0.0])
        self.within = np.zeros(size, np.float64)
        n = np.zeros(size)
        n[: len(frequent)] += [count for _, count in frequent]
        for c, tokens in hashed.items():
            self.within[c] = -np.log(tokens)
            n[c] += tokens
        n[:-1] += 1  # the edge is never a target
        self.start = self._biases(n)

    def _biases(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log shares of groups, and of classes in their group."""
        g, m = groups(self.size)
        held = np.zeros(g * m)
        held[: self.size] = n
        held = held.reshape(g, m)
        total = held.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = np.where(held > 0, np.log(held / total), NONE)
            outer = np.where(total > 0, np.log(total / held.sum()), NONE)
        return outer.ravel().astype(np.float32), inner.astype(np.float32)

    def hashed(self, value):
        """The class of a word without its own, by its hash; or of many, by an array."""
        return self.frequent + value % (self.size - self.frequent - 1)

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """The class and the number of each word; the places of those without a number of their own, and these words."""
        other = len(self.words)
        at = pc.fill_null(pc.index_in(words, value_set=self.words), other).to_numpy()
        found = self.class_of[at]
        rest = np.flatnonzero(at == other)
        others = words.take(pa.array(rest))
        found[rest] = self.hashed(_hashes(others))
        return found, at, rest, others

    def ids(self, text: str | None) -> np.ndarray:
        whole = pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.binary()).view(pa.string())
        return self.known(_split(whole)[0])[0]


def counted(docs: DataFrame) -> DataFrame:
    """``word, hash, n`` of every distinct word of all documents."""
    counts = docs.select("text").mapInArrow(_counted, "word binary, n long, hash long")
    return stage(counts.groupBy("word", "hash").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """Classes from the word counts over all documents.

    The driver sees the frequent words, ``CACHED`` words, a row per class, and how many
    words have about each count: sixteen rows for a doubling of the count.
    """
    counts = counted(docs) if counts is None else counts
    about = F.floor(F.log2("n") * 16).alias("about")
    held = counts.groupBy(about).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    size = max(CLASSES, 4 * math.isqrt(sum(r["words"] for r in held)))
    own = size * 3 // 4
    above, floor, cached_from = 0, 1, 2**62
    for r in sorted(held, key=lambda r: -r["n"]):
        if above < own:
            floor = r["n"]
        above += r["words"]
        if above <= CACHED:
            cached_from = r["n"]
    top = counts.filter(F.col("n") >= floor).orderBy(F.desc("n"), "word").limit(own).select("word", "n").collect()
    rest = counts
    if top:
        last = top[-1]
        higher = (F.col("n") > last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") <= F.lit(bytes(last["word"]))))
        rest = counts.filter(~higher)
    place = (F.lit(own) + F.pmod("hash", F.lit(size - own - 1))).cast("int").alias("place")
    hashed = rest.groupBy(place).agg(F.sum("n").alias("n")).collect()
    cached = counts.filter(F.col("n") >= cached_from).select("word", "n", "hash").collect()
    return Vocabulary(
        size,
        [(bytes(r["word"]), r["n"]) for r in top],
        {r["place"]: r["n"] for r in hashed},
        sorted((bytes(r["word"]), r["n"], r["hash"]) for r in cached),
        cached_from,
    )


def encoded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """``row, doc_id, n_tokens, logs, ids, others``: each text as the classes of its words, written.

    ``row`` is unique, ``logs`` the summed logs of the counts of the cached words; ``others`` are the
    words that are neither cached nor a class of their own.
    """
    kind = np.uint16 if words.size <= 1 << 16 else np.uint32

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, "text"):
                split, n = _split(piece.column("text"))
                ids, at, rest, others = words.known(split)
                ids, logs = ids.astype(kind), words.log_of[at]
                ends = np.cumsum(n)
                spans = list(zip((ends - n).tolist(), ends.tolist(), strict=True))
                left = pa.array(np.searchsorted(rest, np.concatenate([[0], ends])), pa.int32())
                yield pa.record_batch(
                    {
                        "doc_id": piece.column("doc_id"),
                        "n_tokens": pa.array(n, pa.int64()),
                        "logs": pa.array([logs[i:j].sum() for i, j in spans], pa.float64()),
                        "ids": pa.array([ids[i:j].tobytes() for i, j in spans], pa.binary()),
                        "others": pa.ListArray.from_arrays(left, others),
                    }
                )

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    made = texts.mapInArrow(rows, "doc_id long, n_tokens long, logs double, ids binary, others array<binary>")
    return stage(made.withColumn("row", F.monotonically_increasing_id()))


def initial(words: Vocabulary) -> np.ndarray:
    """Small fixed random weights; the biases start at the words' frequencies."""
    random = np.random.default_rng(10)
    drawn = [random.normal(0, 0.1, s).astype(np.float32) for s in sizes(words.size)]
    drawn[1][-1], drawn[2][:, -1] = words.start
    return np.concatenate([part.ravel() for part in drawn])


def parts(flat: np.ndarray, classes: int) -> list[np.ndarray]:
    """The flat weights in the shapes of :func:`sizes` (views)."""
    out, at = [], 0
    for s in sizes(classes):
        n = math.prod(s)
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def hidden(weights: list[np.ndarray], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hidden values of the tokens at ``at``, a column each, and a 1 for the bias."""
    return _hidden(weights, ids, at).T


def _hidden(weights: list[np.ndarray], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = weights[0][0].take(ids[at + OFFSETS[0]], axis=0)
    near = np.empty_like(total)
    for k, offset in enumerate(OFFSETS[1:], 1):
        total += weights[0][k].take(ids[at + offset], axis=0, out=near, mode="clip")  # no place is outside
    out = np.ones((len(at), HIDDEN + 1), total.dtype)
    np.tanh(total, out=out[:, :-1])
    return out


def _large(weights: np.ndarray) -> bool:
    """Whether a score may be large; no hidden value exceeds 1, so the weights bound the scores."""
    return bool(np.abs(weights).sum(axis=-2).max() > LARGE)


def _error(
    weights: np.ndarray, h: np.ndarray, chosen: tuple, large: bool, counts: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The gradients at the hidden values and at the weights: of the softmax less 1 at ``chosen``.
    Places that don't count have none."""
    error = h @ weights
    if large:
        error -= error.max(axis=-1, keepdims=True)
    np.exp(error, out=error)
    total = error.sum(axis=-1)
    error[chosen] -= total
    share = (1 / total if counts is None else counts / total)[..., None]
    inner = error @ weights[..., :-1, :].swapaxes(-1, -2)
    inner *= share
    return inner, (h * share).swapaxes(-1, -2) @ error


def _log_share(weights: np.ndarray, h: np.ndarray, chosen: tuple, large: bool) -> np.ndarray:
    """The log probability of the choice ``chosen`` of each token."""
    scores = h @ weights
    if large:
        scores -= scores.max(axis=-1, keepdims=True)
    own = scores[chosen].astype(np.float64)
    np.exp(scores, out=scores)
    return own - np.log(scores.sum(axis=-1).astype(np.float64))


def _by_group(own: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of tokens by group, groups of more tokens first, and their groups and members in it."""
    g, m = groups(classes)
    group = own // m
    rank = np.empty(g, np.uint16 if g < 1 << 16 else np.int64)
    rank[np.argsort(-np.bincount(group, minlength=g), kind="stable")] = np.arange(g)
    order = np.argsort(rank[group], kind="stable")
    group = group[order]
    return order, group, own[order] - group * m


def _spans(group: np.ndarray) -> Iterator[tuple]:
    """Tokens whose groups are weighed in one product: the groups, the tokens, an index of each token's choice
    but for its last part, and which tokens count. Tokens of a group lie together. A group of many tokens goes
    alone, in pieces, without an index; others go together with groups of about as many, a row each."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    held = np.diff(starts, append=len(group))
    order = np.argsort(-held, kind="stable")
    sizes_, i = held[order].tolist(), 0
    firsts, owners = starts[order].tolist(), group[starts[order]].tolist()
    while i < len(order):
        widest, j = sizes_[i], i + 1
        if widest > ALONE:
            for first in range(firsts[i], firsts[i] + widest, BLOCK):
                yield owners[i], slice(first, min(first + BLOCK, firsts[i] + widest)), None, None
        else:
            while j < len(order) and sizes_[j] > FILLED * widest:
                j += 1
            some = order[i:j, None]
            within = np.arange(widest)
            counts = within < held[some]
            yield group[starts[some[:, 0]]], np.where(counts, starts[some] + within, 0), (np.arange(j - i)[:, None], within), counts
        i = j


def _pieces(group: np.ndarray) -> Iterator[tuple]:
    """What :func:`_spans` gives for tokens in the order of :func:`_by_group`, but groups that go alone
    come as lists of ``(group, tokens)``, one after another and of ``BLOCK`` tokens at most, and a None."""
    runs: list[tuple[int, slice]] = []
    for some, here, index, counts in _spans(group):
        if runs and (counts is not None or here.stop - runs[0][1].start > BLOCK):
            yield runs, None, None, None
            runs = []
        if counts is None:
            runs.append((some, here))
        else:
            yield some, here, index, counts
    if runs:
        yield runs, None, None, None


def _blocks(n: int) -> Iterator[list[tuple[int, slice]]]:
    """All of ``n`` tokens as runs of one group."""
    return ([(0, slice(i, min(i + BLOCK, n)))] for i in range(0, n, BLOCK))


def _scores(weights: np.ndarray, h: np.ndarray, runs: list[tuple[int, slice]], large: bool, room: np.ndarray) -> np.ndarray:
    """The scores of the tokens of ``runs``, each by the weights of its group. They take ``room``."""
    start, end = runs[0][1].start, runs[-1][1].stop
    scores = room[: (end - start) * weights.shape[-1]].reshape(end - start, -1)
    for g, here in runs:
        np.matmul(h[here], weights[g], out=scores[here.start - start : here.stop - start])
    if large:
        scores -= scores.max(axis=1, keepdims=True)
    return scores


def _room(weights: list[np.ndarray]) -> np.ndarray:
    """Room for the scores of a block, used again and again."""
    return np.empty(BLOCK * max(weights[1].shape[-1], weights[2].shape[-1]), weights[0].dtype)


def _places(scores: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Where the flat scores have those of the members."""
    return np.arange(0, scores.size, scores.shape[1]) + member


def _add_errors(
    weights: np.ndarray,
    h: np.ndarray,
    runs: list[tuple[int, slice]],
    member: np.ndarray,
    large: bool,
    room: np.ndarray,
    inner: np.ndarray,
    change: np.ndarray,
    weight: float,
) -> None:
    """Adds what :func:`_error` gives for the tokens of ``runs``, times ``weight``, to ``inner`` and ``change``.
    What is done to each score is done to all runs at once, so that groups of few tokens cost few calls."""
    start, end = runs[0][1].start, runs[-1][1].stop
    error = _scores(weights, h, runs, large, room)
    np.exp(error, out=error)
    total = error @ np.ones(error.shape[1], error.dtype)
    error.reshape(-1)[_places(error, member[start:end])] -= total
    share = (weight / total)[:, None]
    shared = h[start:end] * share
    back = np.empty((end - start, HIDDEN), error.dtype)
    for g, here in runs:
        at = slice(here.start - start, here.stop - start)
        part = error[at]
        np.matmul(part, weights[g, :-1].T, out=back[at])
        change[g] += shared[at].T @ part
    back *= share
    inner[start:end] += back


def _log_shares(
    weights: np.ndarray, h: np.ndarray, runs: list[tuple[int, slice]], member: np.ndarray, large: bool, room: np.ndarray
) -> np.ndarray:
    """What :func:`_log_share` gives for the tokens of ``runs``."""
    scores = _scores(weights, h, runs, large, room)
    own = scores.reshape(-1)[_places(scores, member[runs[0][1].start : runs[-1][1].stop])].astype(np.float64)
    np.exp(scores, out=scores)
    return own - np.log((scores @ np.ones(scores.shape[1], scores.dtype)).astype(np.float64))


def _sums(rows: np.ndarray, near: list[np.ndarray], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes seen at each offset, as class + classes * the offset's number, and the sums of their rows.
    ``near`` has each row's class by offset."""
    kind = np.uint16 if classes <= 1 << 16 else np.int64  # of 16 bits are sorted in linear time
    orders = [np.argsort(c.astype(kind), kind="stable") for c in near]
    near = np.concatenate([c[order] + k * classes for k, (c, order) in enumerate(zip(near, orders, strict=True))])
    rows = rows.take(np.concatenate(orders), axis=0)
    starts = np.flatnonzero(np.diff(near, prepend=-1))
    held = np.diff(starts, append=len(near))
    order = np.argsort(-held.astype(np.int16 if len(near) < 1 << 15 else np.int64), kind="stable")
    starts, held = starts[order], held[order]
    total = rows.take(starts, axis=0)
    # Classes of many rows are summed one by one; then the second rows of all others at once, the third ones, and so on.
    many, *more = np.searchsorted(-held, -np.arange(SUMMED, 0, -1)).tolist()
    if many:
        own = held[:many]
        ends = np.cumsum(own)
        places = np.arange(ends[-1]) + np.repeat(starts[:many] - ends + own, own)
        total[:many] = np.add.reduceat(rows.take(places, axis=0), ends - own, axis=0)
    for i, end in enumerate(reversed(more), 1):
        total[many:end] += rows.take(starts[many:end] + i, axis=0)
    return near[starts], total


def train_step(flat: np.ndarray, squares: np.ndarray, ids: np.ndarray, at: np.ndarray, classes: int) -> None:
    """One step of adaptive gradient descent on the tokens at ``at``, in place."""
    if not len(at):
        return
    weights, sums = parts(flat, classes), parts(squares, classes)
    order, group, member = _by_group(ids[at], classes)
    at = at[order]
    h = _hidden(weights, ids, at)
    n = len(at)

    def descend(part: np.ndarray, squared: np.ndarray, g: np.ndarray, where: np.ndarray | None = None) -> None:
        total = squared if where is None else squared.take(where, axis=0)
        root = g * g
        total += root
        if where is not None:
            squared[where] = total
        np.sqrt(total, out=root)
        g *= RATE
        g /= root
        if where is None:
            part -= g
        else:
            part[where] = np.subtract(part.take(where, axis=0, out=root, mode="clip"), g, out=g)

    inner, outer, lower = np.zeros((n, HIDDEN), flat.dtype), np.zeros_like(weights[1]), np.zeros_like(weights[2])
    room = _room(weights)
    large = _large(weights[1])
    for runs in _blocks(n):
        _add_errors(weights[1][None], h, runs, group, large, room, inner, outer[None], 1 / n)
    large = _large(weights[2])
    for some, here, index, counts in _pieces(group):
        if counts is None:
            _add_errors(weights[2], h, some, member, large, room, inner, lower, 1 / n)
        else:
            error, lower[some] = _error(weights[2][some], h[here], (*index, member[here]), large, counts.astype(flat.dtype) / n)
            inner[here[counts]] += error[counts]
    descend(weights[1], sums[1], outer)
    seen = group[np.flatnonzero(np.diff(group, prepend=-1))]
    if len(seen) == len(lower):
        descend(weights[2], sums[2], lower)
    else:
        descend(weights[2], sums[2], lower[seen], seen)
    inner *= 1 - h[:, :-1] ** 2
    # Only classes that were seen at an offset have a gradient.
    seen, total = _sums(inner, [ids[at + offset] for offset in OFFSETS], classes)
    descend(weights[0].reshape(-1, HIDDEN), sums[0].reshape(-1, HIDDEN), total, seen)


def _joined(size: int, texts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts with edges between them; the place and the text of each token."""
    edge = np.full(EDGE, size - 1, np.intp)
    pieces, places, owners, at = [edge], [], [], EDGE
    for i, own in enumerate(texts):
        pieces += [own, edge]
        places.append(np.arange(at, at + len(own)))
        owners.append(np.full(len(own), i))
        at += len(own) + EDGE
    empty = np.empty(0, np.int64)
    return np.concatenate(pieces, dtype=np.intp), np.concatenate([empty, *places]), np.concatenate([empty, *owners])


def _slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded bytes, so that long texts don't pile up."""
    held = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    starts = np.flatnonzero(np.diff(np.cumsum(held, dtype=np.int64) // most, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], len(held)], strict=len(held) > 0):
        yield batch.slice(start, end - start)


def _ids(size: int, held) -> Iterator[np.ndarray]:
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    return (np.frombuffer(ids, kind) for ids in held)


def targets(at: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The tokens to predict in a round of training: over all rounds, every token once."""
    return at[turn::rounds]


def shards_of(tokens: int) -> tuple[int, int]:
    """The number of shards of a corpus, and the tokens of a training step."""
    shards = max(1, tokens // SHARD_TOKENS)
    return shards, min(max(tokens // shards // STEPS_OF_SHARD, STEPS[0]), STEPS[1])


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """``shard, ids`` of encoded texts, by shard and in an order that their doc_ids and classes alone decide."""
    spot = F.xxhash64("doc_id", "ids")
    shard = F.pmod(spot, F.lit(shards)).cast("int")
    cut = rows.filter("n_tokens > 0").select(shard.alias("shard"), spot.alias("spot"), "ids")
    return stage(cut.repartition("shard").sortWithinPartitions("shard", "spot", "ids").select("shard", "ids"))


def train(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS, rows: DataFrame | None = None) -> np.ndarray:
    """Weights after ``rounds`` rounds: every shard trains on its documents from the same start,
    then weights are averaged by the tokens they have seen, in the tasks and by a sum.
    Every token is a target in exactly one round. Neither tasks nor partitions matter; rows
    that are equal in doc_id and classes share a shard. ``rows`` are the encoded documents."""
    flat, size = initial(words), words.size
    if not rounds:
        return flat
    rows = encoded(docs, words) if rows is None else rows
    shards, size_of_step = shards_of(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    texts = dealt(rows, shards)

    def packed(seen: float, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"seen": [seen], "weights": [total.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = 0.0, None
        for batch in batches:
            for n, w in zip(batch["seen"], batch["weights"], strict=True):
                w = np.frombuffer(w, np.float64)
                seen, total = seen + n, w.copy() if total is None else total + w
        if total is not None:
            yield packed(seen, total)

    for turn in range(rounds):
        start = flat

        def learn(batches: Iterator[pd.DataFrame], start=start, turn=turn) -> Iterator[pd.DataFrame]:
            """A sum over the shards of a task; a shard lies in one task, and its rows together."""
            shard = own = squares = total = None
            seen, all_seen = 0, 0.0
            held: list[np.ndarray] = []  # texts wait until there are a few whole steps
            waiting = 0

            def steps() -> None:
                nonlocal held, waiting, seen
                ids, at, _ = _joined(size, held)
                at = targets(at, turn, rounds)
                for i in range(0, len(at), size_of_step):
                    train_step(own, squares, ids, at[i : i + size_of_step], size)
                seen, held, waiting = seen + len(at), [], 0

            def close() -> None:
                nonlocal total, all_seen
                steps()
                weighted = own.astype(np.float64) * seen
                total = weighted if total is None else total + weighted
                all_seen += seen

            for batch in batches:
                for number, ids in zip(batch["shard"], _ids(size, batch["ids"]), strict=True):
                    if number != shard:
                        if shard is not None:
                            close()
                        shard, own, squares, seen = number, start.copy(), np.full_like(start, 1e-4), 0
                    held.append(ids)
                    waiting += len(ids)
                    if waiting >= 8 * size_of_step * rounds:
                        steps()
            if shard is not None:
                close()
                yield packed(all_seen, total)

        trained = stage(texts.mapInPandas(learn, "seen double, weights binary"))
        some = math.isqrt(shards)  # a task adds up as many weights of others as there are sums to add then
        sums = trained.repartition(some).mapInPandas(added, trained.schema).coalesce(1).mapInPandas(added, trained.schema)
        found = sums.first()  # one row, as large as the network
        if found is None:
            break
        flat = (np.frombuffer(found["weights"], np.float64) / max(1.0, found["seen"])).astype(np.float32)
    return flat


def log_probabilities(words: Vocabulary, flat: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log probability of every token at ``at`` given both sides, without the log of the
    count of a word that shares its class."""
    return _log_probabilities(parts(flat, words.size), words.size, words.within, ids, at)


def _log_probabilities(weights: list[np.ndarray], size: int, within: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at))
    large, large_below = _large(weights[1]), _large(weights[2])
    room = _room(weights)
    for i in range(0, len(at), CHUNK):
        order, group, member = _by_group(ids[at[i : i + CHUNK]], size)
        h = _hidden(weights, ids, at[i : i + CHUNK][order])
        found = np.empty(len(h))
        for runs in _blocks(len(h)):
            found[runs[0][1]] = _log_shares(weights[1][None], h, runs, group, large, room)
        for some, here, index, counts in _pieces(group):
            if counts is None:
                found[some[0][1].start : some[-1][1].stop] += _log_shares(weights[2], h, some, member, large_below, room)
            else:
                share = _log_share(weights[2][some], h[here], (*index, member[here]), large_below)
                found[here[counts]] += share[counts]
        out[i + order] = found
    return out + within[ids[at]]


def joined_logs(rows: DataFrame, counts: DataFrame, words: Vocabulary) -> DataFrame:
    """``row, joined``: the summed logs of the counts of a text's words that are not cached.

    Words seen once add nothing. A word that is not cached has less than one in ``CACHED`` of
    all tokens, however its text is copied, so none is a hot key. Each of these words occurs
    more often than once, so their table is the smaller side, and is hashed instead of sorting the uses.
    """
    uses = rows.select("row", F.explode("others").alias("word"))
    counts = counts.filter((F.col("n") > 1) & (F.col("n") < words.cached_from))
    logs = counts.select("word", F.log("n").alias("log")).hint("shuffle_hash")
    return uses.join(logs, "word").groupBy("row").agg(F.sum("log").alias("joined"))


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, log_prob, mean_log_prob``.

    ``log_prob`` sums the natural log probabilities of all words of the whole text, each
    given the two words on both sides: that of its class, and in a class of several words
    its share of the class's occurrences in ``docs``. ``mean_log_prob`` is per word and null without
    words, as for null and empty texts, whose ``log_prob`` is 0. Words are those between
    white space with A-Z lowered. Repeated rows get equal answers; how rows are spread over
    partitions changes no answer but in its last digits. Other columns are not read. No
    rows give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    counts = counted(texts)
    words = vocabulary(texts, counts)
    rows = encoded(texts, words)
    flat = train(texts, words, rounds, rows)
    size, within = words.size, words.within

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = parts(flat, size)
        for batch in batches:
            for piece in _slices(batch, "ids"):
                ids, at, owner = _joined(size, _ids(size, piece.column("ids").to_pylist()))
                total = np.bincount(owner, _log_probabilities(weights, size, within, ids, at), len(piece))
                total = total + piece.column("logs").to_numpy()
                yield piece.select(["row", "doc_id", "n_tokens"]).append_column("total", pa.array(total))

    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob")
    found = rows.select("row", "doc_id", "n_tokens", "logs", "ids").mapInArrow(
        scored, "row long, doc_id long, n_tokens long, total double"
    )
    found = found.join(joined_logs(rows, counts, words), "row", "left")
    log_prob = (F.col("total") + F.coalesce("joined", F.lit(0.0))).alias("log_prob")
    return found.select("doc_id", "n_tokens", log_prob).select("*", mean)
