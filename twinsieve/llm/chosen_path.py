"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles. Equal sets are one class, found by their digest; the join runs over
classes. Each class has a sketch of minwise tokens. In every tree a node picks few of the sketch's coordinates at
random, so that a pair at the threshold agrees in one of them on average, and its members go to the child named
by their token there. Nodes small enough are compared exhaustively by bits of the sketches; larger ones branch
again, and what is still large at the last level is compared block by block. Members of a crowded node have a row for each
coordinate that it picks (1 / threshold on average) at each level below. Independent trees repeat that. The worst
case is a pair at the threshold whose nodes all go down to the last level: it survives there from each of the roots' about
29 choices with a probability of 0.85 x 0.468 at a threshold of 0.85. All trees share one sketch, in which such a pair agrees now
more, now less; averaged over that it is missed with a probability of about 2 in 1,000,000, at a threshold of 0.8 of about 5.

Nothing emits pairs. A node gives a forest over its similar members, so candidates are clusters; the full sets of
a cluster's members, each fetched once, are intersected with each other where they lie, and links are what passes
the exact test. Clusters of many members or long texts are again split into blocks. Of many blocks one meets all others first;
blocks of members that this puts into one component do not meet again, so rows grow with the square of a group only where its
members are not linked with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, materialize, small
from .base import by_batch, kept, texts
from .graphs import components

COORDINATES = 128
TREES = 20
LEVELS = 3
LEAF = 512  # members of a node, or of a block of a cluster, that are compared exhaustively
DIRECT = 8  # blocks that all meet; more of them meet one block first
BLOCK_SHINGLES = 4 << 20  # shingles in a block
MEMO = 400_000


class Rule(NamedTuple):
    """Words in a shingle, and the smallest similarity of a link in percent."""

    words: int
    percent: int


# ---------------------------------------------------------------- sets and sketches

_known: dict[bytes, int] = {}
_MIX = np.random.default_rng(20240517).integers(1, 1 << 63, (2, COORDINATES), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(batch: list[str], size: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's different shingles."""
    cut = [t.encode().lower().split() for t in batch]
    if len(_known) > MEMO:
        _known.clear()
    for word in set(chain.from_iterable(cut)).difference(_known):
        _known[word] = xxhash.xxh64_intdigest(word)
    sets = []
    for words in cut:
        if len(words) < size:
            sets.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64))
            continue
        h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
        n = len(words) - size + 1
        with np.errstate(over="ignore"):
            x = h[:n].copy()
            for k in range(1, size):
                x = _mixed(x) + h[k : n + k]
        sets.append(np.unique(_mixed(x)))
    return sets


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(set, coordinate): the smallest token under each hash function; zeros for empty sets."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):  # runs that stay in the processor's cache
        end, size = at, 0
        while end < len(full) and (end == at or size + len(sets[full[end]]) <= 32_768):
            size += len(sets[full[end]])
            end += 1
        rows = full[at:end]
        x = np.concatenate([sets[i] for i in rows])
        starts = np.r_[0, np.cumsum([len(sets[i]) for i in rows[:-1]])].astype(np.int64)
        with np.errstate(over="ignore"):
            for j in range(COORDINATES):
                out[rows, j] = np.minimum.reduceat((x * _MIX[0, j] + _MIX[1, j]) >> np.uint64(32), starts)
        at = end
    return out


def _sketched(columns, size):
    sets = shingle_sets(columns["text"].to_pylist(), size)
    return {
        "doc_id": columns["doc_id"], "n_shingles": [len(s) for s in sets],
        "digest": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets],
        "sketch": [row.tobytes() for row in sketches(sets)],
    }


# ---------------------------------------------------------------- trees

BITS = COORDINATES // 4  # bytes of a short sketch: two bits of every coordinate
NODE = "node bigint, rep bigint, n int, bits binary"
_ALL = (1 << 64) - 1


def _short(sketch: np.ndarray) -> np.ndarray:
    low = (sketch & 3).astype(np.uint8)
    return low[:, 0::4] | low[:, 1::4] << 2 | low[:, 2::4] << 4 | low[:, 3::4] << 6


def _chosen(node: int, rate: float, at_least: int = 0) -> np.ndarray:
    """The coordinates that a node picks, each with probability ``rate``."""
    drawn = _mixed(np.arange(COORDINATES, dtype=np.uint64) + _mixed(np.array([node], np.uint64)))
    found = np.flatnonzero(drawn < np.uint64(rate * 2.0**64))
    return found if len(found) >= at_least else np.argsort(drawn)[:at_least]


def _children(node: int, coordinate: int, tokens: np.ndarray) -> np.ndarray:
    seed = _mixed(_mixed(np.array([node], np.uint64)) + np.uint64(coordinate + 1))
    return _mixed(seed + tokens.astype(np.uint64))


def _places(sketch: np.ndarray, trees: range, rate: float, crowded: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, members, node of each) of all that rows are members of; those of ``crowded``, sorted by level, branch again."""

    def below(node: int, members: np.ndarray, level: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for j in _chosen(node, rate, int(level == 0)):
            found = _children(node, int(j), sketch[members, j]).view(np.int64)
            yield level, members, found
            if level < len(crowded):
                inner = np.flatnonzero(_among(found, crowded[level]))
                inner = inner[np.argsort(found[inner], kind="stable")]
                for same in np.split(inner, np.flatnonzero(np.diff(found[inner])) + 1) if len(inner) else ():
                    yield from below(int(found[same[0]]) & _ALL, members[same], level + 1)

    for tree in trees:
        yield from below(tree, np.arange(len(sketch)), 0)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _sketch_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            yield part, np.frombuffer(b"".join(part["sketch"].to_pylist()), np.uint32).reshape(-1, COORDINATES)


def sized(classes: DataFrame, trees: range, rate: float, crowded: Broadcast) -> DataFrame:
    """(node, members) of the level below ``crowded``: the sizes of its nodes, in parts that are still to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deepest = len(crowded.value)
        for _, sketch in _sketch_parts(batches):
            found = [nodes for level, _, nodes in _places(sketch, trees, rate, crowded.value) if level == deepest]
            if found:
                node, members = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"node": pa.array(node), "members": pa.array(members)})

    return classes.select("sketch").mapInArrow(run, "node bigint, members bigint")


def branched(classes: DataFrame, trees: range, rate: float, crowded: Broadcast, is_large: bool) -> DataFrame:
    """A row for each member of the nodes that branch no further: those of at most LEAF members, or the larger ones of the last
    level if ``is_large``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = crowded.value
        for part, sketch in _sketch_parts(batches):
            rep, n = part["rep"].to_numpy(), part["n"].to_numpy()
            bits = pa.array([x.tobytes() for x in _short(sketch)], pa.binary())
            at, nodes = [], []
            for level, members, node in _places(sketch, trees, rate, large[: LEVELS - 1]):
                if is_large and level < LEVELS - 1:
                    continue
                here = _among(node, large[level]) == is_large if level < len(large) else slice(None)
                at.append(members[here])
                nodes.append(node[here])
            if at:
                at = np.concatenate(at)
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate(nodes)), "rep": pa.array(rep[at]), "n": pa.array(n[at]), "bits": bits.take(pa.array(at))})

    return classes.mapInArrow(run, NODE)


def _stars(mask: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the smallest rep of its component in the mask."""
    label = np.arange(len(rep))[np.argsort(np.argsort(rep, kind="stable"), kind="stable")]  # rank by rep
    np.fill_diagonal(mask, True)
    while True:
        lower = np.where(mask, label[None, :], len(label)).min(1)
        if (lower == label).all():
            break
        label = lower
    by_rank = np.sort(rep)
    head = by_rank[label]
    far = head != rep
    return rep[far], head[far]


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a key ends, with the places where keys begin; input is sorted by key."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and (not rest or rest[-1][key][-1].as_py() == keys[0]):
            rest.append(batch)
            continue
        whole = pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks().to_batches() if rest or last else []
        rest = [batch.slice(last)]
        for out in whole:
            k = out[key].to_numpy()
            yield out, np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    if rest:
        for out in pa.Table.from_batches(rest).combine_chunks().to_batches():
            k = out[key].to_numpy()
            yield out, np.flatnonzero(np.r_[True, k[1:] != k[:-1]])


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([empty, *a])), "b": pa.array(np.concatenate([empty, *b]))})


def compared(nodes: DataFrame, percent: int) -> DataFrame:
    """Forests over the members of each node whose sketches may belong to linked sets."""
    agree = 0.25 + 0.75 * percent / 100
    # Five standard deviations above the mismatches expected at the threshold.
    most = int(COORDINATES * (1 - agree) + 5 * (COORDINATES * agree * (1 - agree)) ** 0.5)

    def like(one: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        x = one ^ other
        off = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(-1)
        return (off <= most) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _runs(batches, "node"):
            sizes = np.diff(np.r_[starts, batch.num_rows])
            if sizes.max() < 2:
                continue
            rep, n = batch["rep"].to_numpy(), batch["n"].to_numpy().astype(np.int64)
            bits = np.frombuffer(b"".join(batch["bits"].to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            a, b = [], []
            two = starts[sizes == 2]
            same = two[like(bits[two], bits[two + 1], n[two], n[two + 1])]
            a.append(np.maximum(rep[same], rep[same + 1]))
            b.append(np.minimum(rep[same], rep[same + 1]))
            for at, size in zip(starts[sizes > 2], sizes[sizes > 2]):
                part = slice(at, at + size)
                mask = like(bits[part, None], bits[None, part], n[part, None], n[None, part])
                x, y = _stars(mask, rep[part])
                a.append(x)
                b.append(y)
            yield _edges(a, b)

    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a bigint, b bigint")


def by_blocks(rows: DataFrame, key: str, weight: Column, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges over rows of (``key``, rep, ...) with more members to a key than ``compare`` can take at once; each row takes up
    ``weight`` of a block.

    Up to DIRECT blocks of a key all meet. Of more, one meets the others first. Members found in one component by that need no more comparisons among
    themselves; a key's largest component is dealt to blocks apart from the others, and only pairs of blocks without it on both
    sides meet. So a group of like members gives rows in proportion to its size; only unlike ones meet block by block.
    """
    blocks = F.ceil(F.sum("weight")).cast("int")
    deal = lambda into: F.pmod(F.xxhash64("rep"), F.col(into)).cast("int")
    weighed = rows.select(key, "rep", weight.alias("weight"))
    sizes = materialize(weighed.groupBy(key).agg(blocks.alias("blocks")), "group-sizes", extremes="blocks", columnar=True)
    own = rows.join(sizes.df, key).withColumn("own", deal("blocks"))
    all_meet = own.filter(F.col("blocks") <= DIRECT).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    few = compare(_met(all_meet, key, F.least("own", "other"), F.greatest("own", "other")).drop("own", "blocks"))
    if (sizes.most or 0) <= DIRECT:
        return few
    own = own.filter(F.col("blocks") > DIRECT)
    weighed = weighed.join(sizes.df.filter(F.col("blocks") > DIRECT).select(key), key, "left_semi")
    # The first block goes to all others, which are met by it where they are.
    meets = F.when(F.col("own") > 0, F.array("own")).otherwise(F.sequence(F.lit(1), F.col("blocks") - 1))
    first = kept(compare(_met(own.withColumn("other", F.explode(meets)), key, "other").drop("own", "blocks")), "first-block")
    named = components(first).select(F.col("vertex").alias("rep"), "component")
    labelled = kept(weighed.join(named, "rep", "left").select(key, "rep", "weight", F.coalesce("component", "rep").alias("component")), "labelled")
    each = labelled.groupBy(key, "component").agg(F.sum("weight").alias("weight"))
    inner = each.groupBy(key).agg(F.max(F.struct("weight", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
    inner = inner.filter("parts > 1").select(key, F.col("top.component").alias("inner"))
    sides = kept(labelled.join(inner, key).select(key, "rep", "weight", (F.col("component") == F.col("inner")).alias("is_inner")), "unlike")
    held, left = (
        sides.filter(F.col("is_inner") == is_inner).groupBy(key).agg(blocks.alias(name)) for name, is_inner in (("held", True), ("left", False))
    )
    sides = sides.drop("weight").join(held, key).join(left, key)
    # Blocks of the others have numbers from 0, those of the largest component follow.
    own = rows.join(sides, [key, "rep"]).withColumn("own", F.when(F.col("is_inner"), F.col("left") + deal("held")).otherwise(deal("left")))
    last = F.when(F.col("is_inner"), F.col("left") - 1).otherwise(F.col("left") + F.col("held") - 1)
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    second = compare(_met(pairs, key, F.least("own", "other"), F.greatest("own", "other")).drop("own", "other", "held", "left", "is_inner"))
    return few.unionByName(first).unionByName(second)


def _met(rows: DataFrame, key: str, *pair: Column | str) -> DataFrame:
    """Rows with a key of their own for each meeting."""
    return rows.withColumn(key, F.xxhash64(key, *pair)).drop("other")


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair of linked classes, but for the trees' small miss rate.

    A class's nodes are worked out anew from its sketch in each pass, so no sketch is shuffled or written; the tasks know the
    crowded nodes. Of these there is at most one for LEAF places of a class: trees whose crowded nodes might not fit a broadcast
    go in several turns.
    """
    rate = 100 / percent / COORDINATES
    places = 2 * classes.count() * LEVELS  # in a tree, about
    at_once = max(1, min(TREES, BROADCAST_BYTES // max(1, 8 * places // LEAF)))
    edges = []
    for tree in range(0, TREES, at_once):
        trees = range(tree, min(TREES, tree + at_once))
        crowded: list[np.ndarray] = []
        share = classes.sparkSession.sparkContext.broadcast
        while len(crowded) < LEVELS:
            counted = sized(classes, trees, rate, share(crowded)).groupBy("node").agg(F.sum("members").alias("members"))
            found = counted.filter(F.col("members") > LEAF).select("node").toArrow()["node"].to_numpy()
            if not len(found):
                break
            crowded = [*crowded, np.sort(found)]
        known = share(crowded)
        edges.append(compared(branched(classes, trees, rate, known, False), percent))
        if len(crowded) == LEVELS:
            large = kept(branched(classes, trees, rate, known, True), "crowded-members")
            edges.append(by_blocks(large, "node", F.lit(1 / LEAF), lambda rows: compared(rows, percent)))
    return edges[0] if len(edges) == 1 else _all(edges)


def _all(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


# ---------------------------------------------------------------- exact links


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """(set, set): sizes of the intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.full(len(values), -1)
    shared = count > 1
    new[shared] = np.arange(shared.sum())
    column = new[column]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(shared.sum()), 4096):
        part = slice(*np.searchsorted(column, [first, first + 4096]))
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[part], column[part] - first] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _linked(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _runs(batches, "cluster"):
            a, b = [], []
            rep = batch["rep"].to_numpy()
            for at, end in zip(starts, np.r_[starts[1:], batch.num_rows]):
                sets = [np.frombuffer(s, np.uint64) for s in batch["shingles"].slice(at, end - at).to_pylist()]
                n = np.array([len(s) for s in sets])
                both = intersections(sets)
                mask = 100 * both >= percent * (n[:, None] + n[None, :] - both)
                x, y = _stars(mask, rep[at:end])
                a.append(x)
                b.append(y)
            yield _edges(a, b)

    return run


def _with_sets(columns, size):
    sets = [s.tobytes() for s in shingle_sets(columns["text"].to_pylist(), size)]
    return {**{k: columns[k] for k in ("cluster", "rep", "blocks")}, "shingles": sets}


def links(docs: DataFrame, clusters: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Stars over the linked classes of each small cluster; links of large ones, by pairs of blocks.

    ``clusters`` has (rep, n, cluster); the sets are made anew from ``docs``, for members only.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    blocks = sizes.select("cluster", F.ceil(F.greatest(F.col("members") / LEAF, F.col("total") / BLOCK_SHINGLES)).alias("blocks"))
    members = materialize(clusters.join(blocks, "cluster").select("rep", "cluster", "blocks"), "members", measure=["rep", "cluster", "blocks"], extremes="blocks", columnar=True)
    hint = F.broadcast if small(members) else (lambda df: df)
    own = docs.join(hint(members.df), docs["doc_id"] == members.df["rep"]).select("cluster", "rep", "blocks", "text")
    sets = by_batch(own, _with_sets, "cluster bigint, rep bigint, blocks bigint, shingles binary", rule.words)
    sets = kept(sets, "member-sets")

    def linked(part: DataFrame) -> DataFrame:
        dealt = part.select("cluster", "rep", "shingles").repartition("cluster").sortWithinPartitions("cluster")
        return dealt.mapInArrow(_linked(rule.percent), "a bigint, b bigint")

    if (members.most or 0) < 2:
        return linked(sets), docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    weight = F.greatest(F.lit(1 / LEAF), F.octet_length("shingles") / (8 * BLOCK_SHINGLES))
    large = kept(by_blocks(sets.filter("blocks > 1").drop("blocks"), "cluster", weight, linked), "block-links")
    return linked(sets.filter("blocks = 1")), large


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    A-Z count as lower case; words are runs without ASCII white space. Fewer words than a shingle has make one
    shingle. Documents without words are linked with nothing, and so are rows with a null doc_id (their component_id is null
    and they are kept). Rows that repeat doc_id and text get the same result each; where a repeated doc_id has another text, each row
    gets the component of its own text. An empty table gives an empty one; columns other than doc_id and text are not looked at.
    """
    rows = texts(docs)
    sketched = kept(by_batch(rows, _sketched, "doc_id bigint, n_shingles bigint, digest string, sketch binary", rule.words), "sketches")
    usable = sketched.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = kept(
        usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").cast("int").alias("n"), F.first("sketch").alias("sketch")), "classes"
    )
    near = candidates(classes.select("rep", "n", "sketch"), rule.percent)
    found = components(near).select(F.col("vertex").alias("rep"), F.col("component").alias("cluster"))
    clusters = kept(classes.select("rep", "n").join(found, "rep"), "clusters")
    stars, large = links(rows, clusters, rule)
    labels = stars.select(F.col("a").alias("rep"), F.col("b").alias("low")).unionByName(
        components(large).select(F.col("vertex").alias("rep"), F.col("component").alias("low"))
    )
    heads = classes.select("digest", "rep").join(kept(labels.groupBy("rep").agg(F.min("low").alias("low")), "labels"), "rep", "left")
    named = kept(heads.select("digest", F.coalesce("low", "rep").alias("head")), "heads")
    out = sketched.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near duplicates: of each group the smallest id stays.

    Rows of one doc_id count as one document, and go or stay together. Rows with a null doc_id stay.
    """
    gone = near_duplicates(docs, rule).filter(~F.col("kept")).select("doc_id").distinct()
    table = materialize(gone, "dropped", measure=["doc_id"], columnar=True)
    return docs.join(F.broadcast(table.df) if small(table) else table.df, "doc_id", "left_anti").select(*docs.columns)
