"""Near-duplicates by a chosen-path similarity join over word shingles.

Each document has a set of distinct shingles and a signature of minwise hashes. A node of
a tree chooses BRANCHES positions of the signature; documents go to the child of each
chosen position and its value. Small nodes are compared exhaustively; a large node that
keeps most of its parent is a dense group, which further branching would not divide, and
is compared in blocks. Independent trees raise the recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shared import words_of
from plumbline.session import stage

WORDS = 5
SIMILARITY = 0.75
POSITIONS = 64  # minwise hashes of a signature
TREES = 5
# With two children a node, a pair that agrees in a share q of the positions still shares a path in
# a tree of depth d with p(d) = 1 - (1 - q p(d - 1)) ** 2. The trees branch on one signature, so misses
# are summed over Binomial(64, 0.75) agreements: five trees find 0.9998 at depth 5, 0.9995 at any depth.
BRANCHES = 2
SMALL = 256  # nodes up to this size are compared exhaustively
DENSE = 0.5  # so are nodes that hold more than this share of their parent
ASKING, ASKED = 256, 1024  # rows of a block on either side
# An estimate from 64 positions is below 0.5 for a true 0.75 in two cases of a million.
LEAST_ESTIMATE = 0.5

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_TURNS = np.random.default_rng(20).integers(0, 2**64, POSITIONS, dtype=np.uint64) | np.uint64(1)


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all shingles; of all words as one, if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=WORDS)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    s = h[:n] * _MIX[0]
    for j in range(1, WORDS):
        s += h[j : j + n] * _MIX[j]
        s ^= s >> np.uint64(31)
    s *= _MIX[1]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """Minwise hashes; long sets go through in pieces."""
    least = np.full(POSITIONS, 2**32 - 1, np.uint32)
    for i in range(0, len(shingle_set), 4096):
        turned = shingle_set[i : i + 4096, None] * _TURNS[None, :]
        least = np.minimum(least, (turned >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return least


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            words = words_of(text)
            found = shingles(words)
            key = xxhash.xxh3_128_digest(b" ".join(words)) if words else None
            rows.append((doc_id, key, len(found), signature(found).tobytes() if words else None))
        out = pd.DataFrame(rows, columns=["doc_id", "words_key", "n_shingles", "sig"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingles(words_of(t)) for t in batch["text"]]
        yield pd.DataFrame({"id": batch["id"], "shingles": [s.tobytes() for s in sets]})


def _hashed(value: int) -> int:
    value = (value ^ (value >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    value = (value ^ (value >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return value ^ (value >> 31)


def chosen(node: np.ndarray) -> np.ndarray:
    """The positions that each node branches on: a function of the node's path alone."""
    first = (node >> np.uint64(7)) % np.uint64(POSITIONS)
    step = np.uint64(1) + (node >> np.uint64(23)) % np.uint64(POSITIONS - 1)
    return np.stack([(first + step * np.uint64(b)) % np.uint64(POSITIONS) for b in range(BRANCHES)], axis=1)


def children(node: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """The child of every row in each branch; rows of one node and one value meet in one child."""
    at = chosen(node)
    value = np.take_along_axis(sigs, at.astype(np.int64), axis=1).astype(np.uint64)
    mixed = (node[:, None] * _MIX[0]) ^ (at * _MIX[2]) ^ ((value + np.uint64(1)) * _MIX[3])
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def _branch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not len(batch):
            continue
        sigs = np.stack([np.frombuffer(s, np.uint32) for s in batch["sig"]])
        below = children(batch["node"].to_numpy().view(np.uint64), sigs)
        out = {"node": below.reshape(-1).view(np.int64)}
        for name in ("id", "held"):
            out[name] = np.repeat(batch[name].to_numpy(), BRANCHES)
        yield pd.DataFrame(out)


def leaves(sigs: DataFrame) -> DataFrame:
    """``node, id, held``: every node to be compared, with its members and their number.

    A level branches all nodes that are too large at once. A node is branched only if it
    holds at most half of its parent, so levels end after a logarithmic number. A member
    that both branches keep in large nodes has two rows on the next level.
    """
    roots = F.array(*[F.lit(_hashed(t + 1) - 2**63) for t in range(TREES)])
    rows = sigs.select("id", "sig", F.explode(roots).alias("node"), F.lit(2**62).alias("held"))
    done: DataFrame | None = None
    while True:
        below = rows.select("node", "id", "held", "sig").mapInPandas(_branch, "node long, id long, held long")
        below = stage(below)
        sizes = below.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("held").alias("was")).filter("n > 1")
        kept = stage(below.drop("held").join(sizes, "node"))
        dense = (F.col("n") <= SMALL) | (F.col("n") > DENSE * F.col("was"))
        ready = kept.filter(dense).select("node", "id", F.col("n").alias("held"))
        done = ready if done is None else done.unionByName(ready)
        large = kept.filter(~dense)
        if large.isEmpty():
            return stage(done)
        rows = large.select("node", "id", F.col("n").alias("held")).join(sigs, "id")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one key after another, from batches sorted by key."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if rest:
            batch = pd.concat([*rest, batch], ignore_index=True)
            rest = []
        marks = batch[keys].to_numpy()
        ends = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        start = 0
        for end in ends:
            yield batch.iloc[start:end]
            start = end
        rest = [batch.iloc[start:]]
    if rest:
        yield rest[0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * 100 >= (len(a) + len(b) - shared) * round(100 * SIMILARITY)


def _estimates(asking: np.ndarray, asked: np.ndarray) -> np.ndarray:
    agree = np.zeros((len(asking), len(asked)), np.uint8)
    for p in range(POSITIONS):
        agree += asking[:, p, None] == asked[None, :, p]
    return agree


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each centre (its set comes first) to those around it."""
    centre, have = None, None
    for batch in batches:
        links = []
        for c, i, s in zip(batch["centre"], batch["id"], batch["shingles"], strict=True):
            if c == i:
                centre, have = c, np.frombuffer(s, np.uint64)
            elif c == centre and similar(have, np.frombuffer(s, np.uint64)):
                links.append((c, i))
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a block that an estimate pairs with one of another component."""
    keys = ["node", "x", "y"]
    for g in _groups(batches, keys):
        sigs = np.stack([np.frombuffer(s, np.uint32) for s in g["sig"]])
        asks = g["asks"].to_numpy()
        comp = g["component"].to_numpy()
        near = _estimates(sigs[asks], sigs[~asks]) >= LEAST_ESTIMATE * POSITIONS
        near &= comp[asks][:, None] != comp[~asks][None, :]
        hit = np.concatenate([near.any(axis=1), near.any(axis=0)])
        if hit.any():
            order = np.concatenate([np.flatnonzero(asks), np.flatnonzero(~asks)])[hit]
            yield g.iloc[order][[*keys, "id", "asks"]]


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Confirmed links of a block, enough to connect what its links connect."""
    for g in _groups(batches, ["node", "x", "y"]):
        ids, comp, asks = g["id"].to_numpy(), g["component"].to_numpy(), g["asks"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
        sigs = np.stack([np.frombuffer(s, np.uint32) for s in g["sig"]])
        places = [frozenset(n) for n in g["nodes"]]
        node = g["node"].iloc[0]
        here, there = np.flatnonzero(asks), np.flatnonzero(~asks)
        near = _estimates(sigs[here], sigs[there]) >= LEAST_ESTIMATE * POSITIONS
        parent = {c: c for c in comp.tolist()}

        def top(c, parent=parent):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        links = []
        for x, y in zip(*np.nonzero(near), strict=True):
            i, j = here[x], there[y]
            a, b = top(comp[i]), top(comp[j])
            # A pair is compared in the first of the nodes that hold both.
            if a != b and min(places[i] & places[j]) == node and similar(sets[i], sets[j]):
                parent[a] = b
                links.append((ids[i], ids[j]))
        if links:
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_links(sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect what all links connect; ``sigs`` is staged: ``id, sig``.

    Every node's members are first compared with its smallest id. Then, in each node,
    members outside its largest component ask all others of another component: blocks of
    ASKING rows against blocks of ASKED rows, by estimate from the signatures, and where
    that is close, by full sets.
    """
    found = leaves(sigs)
    centres = found.groupBy("node").agg(F.min("id").alias("centre"))
    around = found.join(centres, "node").select("centre", "id").distinct()
    involved = around.select("id").distinct()
    sets = stage(texts.join(involved, "id").select("id", "text").mapInPandas(_sets, "id long, shingles binary"))
    # Long stars are cut into pieces that each have a copy of the centre's set.
    around = around.filter("centre <> id").withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(64)))
    cores = around.select("centre", "piece").distinct().withColumn("id", F.col("centre"))
    pieces = around.unionByName(cores).join(sets, "id")
    pieces = pieces.withColumn("spoke", F.col("id") != F.col("centre"))
    pieces = pieces.repartition("centre", "piece").sortWithinPartitions("centre", "piece", "spoke")
    stars = stage(pieces.select("centre", "id", "shingles").mapInPandas(_stars, "a long, b long"))
    joined = stage(components(stars))

    rows = _with_component(found, joined)
    shares = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        shares.groupBy("node")
        .agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("held"))
        .filter("parts > 1")
        .select(
            "node",
            F.col("top.component").alias("main"),
            F.ceil((F.col("held") - F.col("top.n")) / ASKING).cast("int").alias("xs"),
            F.ceil(F.col("held") / ASKED).cast("int").alias("ys"),
        )
    )
    rows = rows.drop("held").join(mixed, "node")
    deal = lambda n: F.pmod(F.xxhash64("id", "node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.filter("component <> main").withColumn("x", deal("xs")).withColumn("y", all_of("ys"))
    asked = rows.withColumn("y", deal("ys")).withColumn("x", all_of("xs"))
    cells = asking.withColumn("asks", F.lit(True)).unionByName(asked.withColumn("asks", F.lit(False)))
    cells = cells.select("node", "x", "y", "id", "component", "asks")
    compared = cells.join(sigs, "id").repartition("node", "x", "y").sortWithinPartitions("node", "x", "y")
    close = stage(compared.mapInPandas(_marks, "node long, x int, y int, id long, asks boolean"))
    at = found.join(close.select("id").distinct(), "id").groupBy("id").agg(F.collect_set("node").alias("nodes"))
    full = _with_component(close, joined).join(sigs, "id").join(sets, "id").join(at, "id")
    full = full.repartition("node", "x", "y").sortWithinPartitions("node", "x", "y")
    return stars.unionByName(stage(full.mapInPandas(_confirmed, "a long, b long")))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    A document's set holds its distinct shingles of five words, or all its words as one
    shingle if they are fewer. Documents are linked at a Jaccard similarity of 0.75 or
    more, confirmed on full sets. ``component_id`` is the smallest doc_id reachable;
    ``kept`` says that it is the row's own. Documents without words (null texts too) are
    linked with nothing. Rows with one doc_id are one document: all their texts count
    for its links. A null doc_id has a null component and is kept. Other columns are not
    read. No rows give no rows.

    Copies (equal words in order) are one class, which the smallest doc_id stands for.
    """
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stage(wanted.mapInPandas(_features, "doc_id long, words_key binary, n_shingles long, sig binary"))
    named = found.filter("words_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = stage(named.groupBy("words_key").agg(F.min("doc_id").alias("id")))
    firsts = named.join(classes, "words_key").filter("doc_id = id").select("id", "sig", "words_key")
    sigs = stage(firsts.dropDuplicates(["id", "words_key"]).select("id", "sig"))
    links = near_links(sigs, wanted.withColumnRenamed("doc_id", "id"))
    # Texts of one doc_id, and all copies of any of them, are one document.
    same = named.join(classes, "words_key").filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    twice = named.groupBy("doc_id").agg(F.count_distinct("words_key").alias("n")).filter("n > 1").select("doc_id")
    links = links.unionByName(same.join(twice, same["a"] == twice["doc_id"], "left_semi"))
    joined = components(links).select("id", "component")
    reached = classes.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    out = found.join(reached.select("words_key", "component"), "words_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group."""
    gone = near_groups(docs).filter("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]) END) AS g FROM w),
h AS (SELECT doc_id, md5(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) r ON r.doc_id = d.doc_id
LEFT JOIN n ON n.doc_id = d.doc_id"""
