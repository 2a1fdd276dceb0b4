"""Personal data: fixed patterns, completed by a skip-chain conditional random field.

The patterns find the base spans. The field labels the tokens that hold a digit or an
at sign (no kind of span is without one): neighbours share chain potentials, repeated
tokens share skip potentials, and loopy message passing makes the labels of a document
agree. It is trained here, in numpy, on the base spans of a bounded sample.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import WORD

KINDS = ["email", "ip", "card", "phone"]  # in the order of the result; label 0 is none of them
SAMPLE = 2000  # documents with a digit or an at sign that the field learns from
WIDTH = 4096  # hashed features of a token
ROUNDS = 10  # of message passing
SURE = 0.95  # least marginal probability of a token that is added

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from every later one.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TELLING = re.compile("[0-9@]")
_TOKEN = re.compile(WORD)


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: all local characters before an at sign, back to the last match."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns in code points, by kind and start; kinds from 1."""
    if not _TELLING.search(text):
        return []
    found = [(1, *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((2, *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(m.group())) if m.end() - m.start() <= 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((3, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((4, *m.span()))
    return found


@dataclass
class Tokens:
    """The tokens of a document that the field labels."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[int]  # places of tokens whose next word is the next token
    skip: list[tuple[int, int]]  # each token and the last before it that is the same


def _shape(word: str) -> str:
    word = re.sub(r"[0-9]{5,}", "00000", word[:64])
    return re.sub(r"a{3,}", "aa", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "0", word)))


def _sameness(word: str) -> str:
    """What makes two tokens the same: their digits, if they are many, or else the bare word."""
    digits = "".join(_DIGIT.findall(word))
    return digits if len(digits) >= 4 and "@" not in word else word.strip(".,;:!?()[]\"'#$%&*").lower()


def tokens_of(text: str) -> Tokens:
    out = Tokens([], [], [], [])
    last: dict[str, int] = {}
    before, before_is_token, waiting = "", False, None
    for m in _TOKEN.finditer(text):
        word = m.group()
        if waiting is not None:
            out.features[waiting].append(zlib.crc32(("next " + _shape(word)).encode("utf-8", "replace")) % WIDTH)
            waiting = None
        telling = _TELLING.search(word) is not None
        if telling:
            place, shape = len(out.spans), _shape(word)
            digits = len(_DIGIT.findall(word))
            names = [f"shape {shape}", f"digits {min(digits, 20)}", f"before {_shape(before)}", f"at {'@' in word}", "any"]
            out.features.append([zlib.crc32(n.encode("utf-8", "replace")) % WIDTH for n in names])
            out.spans.append(m.span())
            if before_is_token:
                out.chain.append(place - 1)
            same = _sameness(word)
            if same in last and len(same) > 1:
                out.skip.append((last[same], place))
            last[same] = place
            waiting = place
        before, before_is_token = word, telling
    return out


def base_labels(tokens: Tokens, spans: list[tuple[int, int, int]]) -> np.ndarray:
    labels = np.zeros(len(tokens.spans), np.int64)
    starts = np.array([s for s, _ in tokens.spans], np.int64)
    ends = np.array([e for _, e in tokens.spans], np.int64)
    for kind, start, end in spans:
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
        held = labels[a:b]
        held[held == 0] = kind
    return labels


@dataclass
class Field:
    unary: np.ndarray  # features by labels
    chain: np.ndarray  # labels by labels
    skip: np.ndarray


def _agreement(met: np.ndarray, most: float) -> np.ndarray:
    """Log of how much more often two labels meet than by chance, within ``most``."""
    met = met + 0.5
    chance = met.sum(1, keepdims=True) * met.sum(0, keepdims=True) / met.sum()
    return np.clip(np.log(met / chance), -most, most)


TOKEN, CHAIN, SKIP = 0, 1, 2


def examples(text: str) -> Iterator[tuple[int, tuple[int, ...]]]:
    """What the field learns from a text: ``TOKEN`` with its label and features, and pairs of labels."""
    tokens = tokens_of(text)
    own = base_labels(tokens, base_spans(text)).tolist()
    for label, features in zip(own, tokens.features, strict=True):
        yield TOKEN, (label, *features)
    for i in tokens.chain:
        yield CHAIN, (own[i], own[i + 1])
    for i, j in tokens.skip:
        yield SKIP, (own[i], own[j])


def fit(counted: dict[tuple[int, tuple[int, ...]], int], steps: int = 120) -> Field:
    """Piecewise training on counted examples: token weights by softmax regression, potentials from label counts."""
    n = len(KINDS) + 1
    rows, columns, labels, times = [], [], [], []
    met = np.zeros((3, n, n))
    for (part, items), count in sorted(counted.items()):
        if part == TOKEN:
            rows += [len(labels)] * (len(items) - 1)
            columns += items[1:]
            labels.append(items[0])
            times.append(count)
        else:
            met[part, items[0], items[1]] += count
    weights = np.zeros((WIDTH, n))
    if not labels:
        return Field(weights, np.zeros((n, n)), np.zeros((n, n)))
    rows, columns, y, times = np.array(rows), np.array(columns), np.array(labels), np.array(times, float)
    squares = np.full((WIDTH, n), 1e-6)
    for _ in range(steps):
        scores = np.zeros((len(y), n))
        np.add.at(scores, rows, weights[columns])
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= times[:, None]
        gradient = 1e-4 * times.sum() * weights
        np.add.at(gradient, columns, p[rows])
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
    return Field(weights, _agreement(met[CHAIN], 2.0), _agreement(met[SKIP], 3.0))


def marginals(field: Field, tokens: Tokens) -> np.ndarray:
    """Label probabilities of each token after loopy sum-product message passing, damped by half."""
    scores = np.stack([field.unary[f].sum(axis=0) for f in tokens.features])
    ends = [(i, i + 1) for i in tokens.chain] + tokens.skip
    if ends:
        a, b = np.array(ends).T
        potential = np.concatenate([np.repeat(field.chain[None], len(tokens.chain), 0), np.repeat(field.skip[None], len(tokens.skip), 0)])
        onward, back = np.zeros((len(a), scores.shape[1])), np.zeros((len(a), scores.shape[1]))
        for _ in range(ROUNDS):
            belief = scores.copy()
            np.add.at(belief, b, onward)
            np.add.at(belief, a, back)
            sent = np.logaddexp.reduce((belief[a] - back)[:, :, None] + potential, axis=1)
            returned = np.logaddexp.reduce((belief[b] - onward)[:, None, :] + potential, axis=2)
            onward = 0.5 * onward + 0.5 * (sent - np.logaddexp.reduce(sent, axis=1, keepdims=True))
            back = 0.5 * back + 0.5 * (returned - np.logaddexp.reduce(returned, axis=1, keepdims=True))
        np.add.at(scores, b, onward)
        np.add.at(scores, a, back)
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _fits(kind: int, word: str) -> bool:
    """Whether a span could be of its kind at all."""
    digits = len(_DIGIT.findall(word))
    if kind == 1:
        return re.fullmatch(r"[^@]+@[^@.]+(\.[^@.]+)+", word) is not None
    if kind == 2:
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", word) is not None
    return 13 <= digits <= 19 if kind == 3 else 7 <= digits <= 15


def added_spans(field: Field, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field is sure of and no base span touches."""
    tokens = tokens_of(text)
    if not tokens.spans:
        return []
    p = marginals(field, tokens)
    labels = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
    labels[base_labels(tokens, base) > 0] = 0
    follows = set(tokens.chain)
    found, i = [], 0
    while i < len(labels):
        j = i
        while j in follows and labels[j + 1] == labels[i]:
            j += 1
        if labels[i]:
            start, end = tokens.spans[i][0], tokens.spans[j][1]
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while end > start and not text[end - 1].isalnum():
                end -= 1
            if _fits(int(labels[i]), text[start:end]):
                found.append((int(labels[i]), start, end))
        i = j + 1
    return found


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{s}:{e}" for k, s, e in sorted(spans))


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = Counter(e for text in batch["text"] for e in examples(text))
        rows = [(part, list(items), n) for (part, items), n in found.items()]
        yield pd.DataFrame(rows, columns=["part", "items", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field from about ``sample`` documents with a digit or an at sign, chosen by a hash of the doc_id.

    Their examples are counted in the tasks; the driver gets hashed features and
    counts, one row for each different example, and no text.
    """
    able = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    n = able.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit("private")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = able.filter(chance < F.lit(min(1.0, sample / max(1, n)))).select("text")
    counted = chosen.mapInPandas(_examples, "part int, items array<int>, n long")
    rows = counted.groupBy("part", "items").agg(F.sum("n").alias("n")).collect()
    return fit({(r["part"], tuple(r["items"])): r["n"] for r in rows})


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and digest are of the base spans; ``spans`` lists these and the spans that
    the field adds, by kind and start, in code points with an exclusive end. A null or
    empty text has no spans. Repeated rows get equal answers. Other columns are not read.
    No rows give no rows.
    """
    field = learn(docs, sample)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                listed = _listed(base)
                more = added_spans(field, text, base) if _TELLING.search(text) else []
                counts = [sum(k == kind for k, _, _ in base) for kind in range(1, len(KINDS) + 1)]
                rows.append((*counts, hashlib.sha256(listed.encode()).hexdigest(), _listed(base + more) if more else listed))
            out = pd.DataFrame(rows, columns=[*[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInPandas(search, f"doc_id long, {counts}, base_sha256 string, spans string")
