"""Language identification: the family first, then linear SVMs between its languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import free_names

WIDTH = 4096  # hashed pairs and triples of characters
SAMPLE = 2000  # labelled documents to learn from, shared evenly by the languages
LEAST_EACH = 40
HELD_OUT = 2  # crc32 of the doc_id modulo 4 of documents never learned from
PIECE = 1 << 20  # characters counted at once
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def profile(text: str | None) -> np.ndarray | None:
    """Unit vector of the square roots of hashed n-gram counts of the whole text; None without letters.

    Letters are lowered; everything else is a blank, and only the first of several counts.
    """
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint32)
    points = points[letter | np.concatenate([[True], letter[:-1]])]
    counts = np.zeros(WIDTH)
    for start in range(0, len(points), PIECE):
        c = np.concatenate([[32], points[start : start + PIECE + 2], [32]]).astype(np.uint32)
        pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        triple = pair[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        for grams in (pair, triple):
            counts += np.bincount((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=WIDTH)
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights (the bias last) of a linear SVM with squared hinge loss, by accelerated gradient descent."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))  # both classes weigh the same
    rate = 1 / (1 + 2 * cost * 2)  # rows and their bias have a squared norm of 2
    w = v = np.zeros(x.shape[1] + 1)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1].astype(np.float32) + v[-1]))
        push = share * y * slack
        gradient = v - 2 * cost * np.append(push.astype(np.float32) @ x, push.sum())
        following = v - rate * gradient
        v = following + t / (t + 3) * (following - w)
        w = following
    return w


def families(centres: np.ndarray) -> list[list[int]]:
    """Languages grouped by the likeness of their mean profiles, into about the root of their number.

    Average linkage: the two groups whose members are most alike on average are joined.
    """
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    alike = unit @ unit.T
    groups = [[i] for i in range(len(centres))]
    while len(groups) > max(1, round(len(centres) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    of_family: np.ndarray | None = None  # one row of weights per family
    between: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """A language and how sure it is: the product of the logistic margins of both levels."""
        if not self.languages:
            return UNKNOWN, 0.0
        one, sure = np.append(x.astype(np.float64), 1.0), 1.0
        group = self.families[0]
        if len(self.families) > 1:
            margins = self.of_family @ one
            order = np.argsort(-margins, kind="stable")
            group = self.families[order[0]]
            sure *= 1 / (1 + np.exp(-2 * (margins[order[0]] - margins[order[1]])))
        votes = dict.fromkeys(group, 0.0)
        least = dict.fromkeys(group, np.inf)
        for a, b in combinations(group, 2):
            margin = float(self.between[a, b] @ one)
            votes[a if margin >= 0 else b] += 1 + abs(margin) * 1e-6
            least[a], least[b] = min(least[a], margin), min(least[b], -margin)
        best = max(group, key=lambda g: (votes[g], -g))
        if len(group) > 1:
            sure *= 1 / (1 + np.exp(-4 * least[best]))
        return self.languages[best], float(sure)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model()
    y = np.array([languages.index(v) for v in labels])
    groups = families(np.stack([x[y == i].mean(axis=0) for i in range(len(languages))]))
    model = Model(languages, groups)
    if len(groups) > 1:
        model.of_family = np.stack([svm(x, np.where(np.isin(y, g), 1.0, -1.0)) for g in groups])
    for group in groups:
        for a, b in combinations(group, 2):
            mine = (y == a) | (y == b)
            model.between[a, b] = svm(x[mine], np.where(y[mine] == a, 1.0, -1.0))
    return model


def _held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [profile(t) for t in batch["text"]]
        yield pd.DataFrame(
            [(lang, p.tobytes()) for lang, p in zip(batch["lang"], found, strict=True) if p is not None],
            columns=["lang", "profile"],
        )


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` labelled documents that are not held out.

    The labelled documents of all languages are counted; each language gives an even
    share of the sample, chosen by a hash of the doc_id.
    """
    able = docs.filter(~_held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(LEAST_EACH, sample // max(1, len(counts)))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(rate)
    chosen = able.filter(chance < rate).select("lang", "text").mapInPandas(_profiles, "lang string, profile binary")
    rows = sorted((r["lang"], bytes(r["profile"])) for r in chosen.toLocalIterator())  # in any order of tasks
    if not rows:
        return Model()
    labels = [lang for lang, _ in rows]
    return fit(np.frombuffer(b"".join(p for _, p in rows), np.float32).reshape(len(rows), WIDTH), labels)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    The prediction reads the whole text and nothing else. A text that is null, empty or
    without letters is ``und`` with score 0; so is every text if no labelled document
    has letters. Held out are documents whose crc32 of the doc_id as text leaves 2 modulo
    4; a null doc_id is neither held out nor learned from. Repeated rows get equal
    answers. Other columns are not read. No rows give no rows.
    """
    model = learn(docs, sample)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(UNKNOWN, 0.0) if (p := profile(t)) is None else model.predict(p) for t in batch["text"]]
            out = pd.DataFrame(found, columns=["lang_pred", "score"])
            out["doc_id"] = batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            out["held_out"] = batch["held_out"]
            yield out[["doc_id", "held_out", "lang_pred", "score"]]

    rows = docs.select(F.col("doc_id").cast("long"), _held_out().alias("held_out"), "text")
    return rows.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text has a letter; a null ``lang`` is filled in.

    Only texts without any letter are rejected. If no labelled document could be learned
    from, a null ``lang`` stays null. All columns pass through.
    """
    model = learn(docs, sample)

    def guess(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (p := profile(t)) is None else model.predict(p)[0] for t in texts], dtype=object)

    guessed = F.pandas_udf(guess, "string")(F.col("text"))
    (name_of_guess,) = free_names(docs, 1)
    found = docs.withColumn(name_of_guess, guessed).filter(F.col(name_of_guess).isNotNull())
    lang = (F.coalesce(F.col("lang"), F.col(name_of_guess)) if model.languages else F.col("lang")).alias("lang")
    return found.select(*[lang if name == "lang" else F.col(f"`{name}`") for name in docs.columns])
