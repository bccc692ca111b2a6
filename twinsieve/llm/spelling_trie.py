"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word is its number of letters, followed by how many of them fall into each of GROUPS letter groups. Words arranged by these
numbers, one after the other, form a trie. One replaced letter takes one from a group and gives one to another
(or neither), one deleted letter takes one away: the search for a word walks down the trie with a surplus of one
and a deficit of one to spend. To find each pair once, a word looks for words of its own length with the surplus
before the deficit, and for words one letter shorter with the deficit alone. Words of the leaves that it reaches are
verified, those only whose first or last half is equal, since one edit leaves one of the halves as it is.

The upper levels are Spark's: a node's words are its rows, and a node goes one level down as long as its words are too
many for one task. The lower levels are arrays in the task that has the node.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .base import kept

LETTERS = re.compile(rb"[a-z\xc0-\xff]{7,}")  # of Latin-1 text in ASCII lower case
SHORTEST = 7
OFTEN = 2  # occurrences of a word
DAMAGED = 31  # one run in so many loses a letter
RATIO = 10  # times that a form is more frequent than its variant
COUNTED = 500_000  # different words that a task counts at once
GROUPS = 16
NODE = 512 << 10  # letters of a node's words, or of the words that search it together, at most
FRONT = 1 << 18  # places in the trie that are looked at together
COMPARED = 8 << 20  # letters that are compared together

# Where a search stands: nothing spent; a deficit owed; both spent.
SAME, OWED, SPENT = 0, 1, 2


# ---------------------------------------------------------------- words


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})
        found.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            # Other characters become "?", which is no letter.
            runs = Counter(LETTERS.findall(text.as_py().encode("latin-1", "replace").lower()))
            head = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for run, n in runs.items():
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
                if h % DAMAGED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < SHORTEST:
                        continue
                found[run] += n
            if len(found) > COUNTED:
                yield rows()
    yield rows()


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the different words of (doc_id, text) with at least SHORTEST letters and OFTEN occurrences."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return rows.mapInArrow(_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)


# ---------------------------------------------------------------- the trie


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)


def group_counts(words: list[bytes], groups: np.ndarray) -> np.ndarray:
    """(word, group): how many letters of each word are in each group."""
    letters, length = _flat(words)
    row = np.repeat(np.arange(len(words)), length)
    return np.bincount(row * GROUPS + groups[letters], minlength=len(words) * GROUPS).reshape(len(words), GROUPS).astype(np.int32)


def letter_groups(frequency: np.ndarray) -> np.ndarray:
    """The group of each letter: the most frequent ones first and alone, the others dealt out over the second half."""
    order = np.lexsort((np.arange(256), -frequency))
    own = GROUPS // 2
    group = np.zeros(256, np.int64)
    group[order] = np.where(np.arange(256) < own, np.arange(256), own + (np.arange(256) - own) % (GROUPS - own))
    return group


class Trie:
    """Words of one length with one number for each of the levels above ``level``, by the numbers of the levels from there on."""

    def __init__(self, words: list[bytes], groups: np.ndarray, level: int) -> None:
        counts = group_counts(words, groups)
        order = np.lexsort(counts[:, ::-1].T)
        self.words = [words[i] for i in order]
        self.order = order
        counts = counts[order]
        self.level = level
        self.wide = int(counts.max(initial=0)) + 3  # so that one more or less is no other node's number
        self.children: list[np.ndarray] = []
        node = np.zeros(len(words), np.int64)
        for g in range(level, GROUPS):
            key = node * self.wide + counts[:, g] + 1
            found, node = np.unique(key, return_inverse=True)
            self.children.append(found)
        self.leaf = node

    def _below(self, depth: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.children[depth]
        fits = np.flatnonzero((count >= 0) & (count < self.wide - 2))
        key = node[fits] * self.wide + count[fits] + 1
        at = np.searchsorted(keys, key)
        found = at < len(keys)
        found[found] = keys[at[found]] == key[found]
        return fits[found], at[found]

    def search(self, counts: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(search, leaf, state) for the leaves that each search reaches; depth first, many searches abreast."""
        stack = [(0, np.arange(len(state)), np.zeros(len(state), np.int64), state)]
        while stack:
            depth, who, node, now = stack.pop()
            if len(who) > FRONT:
                half = len(who) // 2
                stack += [(depth, who[half:], node[half:], now[half:]), (depth, who[:half], node[:half], now[:half])]
                continue
            if depth == len(self.children):
                yield who, node, now
                continue
            own = counts[who, self.level + depth]
            steps = [(0, np.arange(len(who)), now), (1, np.flatnonzero(now == SAME), OWED), (-1, np.flatnonzero(now == OWED), SPENT)]
            parts = []
            for change, which, then in steps:
                at, below = self._below(depth, node[which], own[which] + change)
                which = which[at]
                parts.append((who[which], below, now[which] if change == 0 else np.full(len(which), then)))
            who, node, now = (np.concatenate(x) for x in zip(*parts))
            if len(who):
                stack.append((depth + 1, who, node, now))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, place) with low[row] <= place < high[row]."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _padded(words: list[bytes], width: int) -> np.ndarray:
    letters, length = _flat(words)
    out = np.zeros((len(words), width), np.uint8)
    row, place = _spread(np.zeros(len(words), np.int64), length)
    out[row, place] = letters
    return out


def one_edit(a: np.ndarray, b: np.ndarray, shorter: int) -> np.ndarray:
    """Whether rows of ``a`` (words of ``shorter`` letters, or one more) and ``b`` (words of ``shorter`` letters) differ by one edit."""
    width = a.shape[1]
    if width == shorter:
        return (a != b).sum(1) == 1
    same = a[:, :shorter] == b[:, :shorter]
    front = np.where(same.all(1), shorter, (~same).argmax(1))
    back = a[:, 1:] == b[:, :shorter]
    tail = np.where(back.all(1), shorter, (~back[:, ::-1]).argmax(1))
    return front + tail >= shorter


def _halves(words: list[bytes], length: int) -> tuple[list[bytes], list[bytes]]:
    """First and last halves, so short that one edit of a word of ``length`` letters, or from one more, leaves one of them alone."""
    half = length // 2
    return [w[:half] for w in words], [w[len(w) - half :] for w in words]


def near_pairs(home: list[bytes], asked: list[bytes], states: np.ndarray, groups: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``asked``, place in ``home``) of words one edit apart.

    ``home`` are words of one node; ``asked`` search it in the given states. Of two words with equal numbers, which would find
    each other, the smaller one does.
    """
    if not home or not asked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = len(home[0])
    trie = Trie(home, groups, level)
    counts = group_counts(asked, groups)
    # Halves as numbers: equal ones have one number.
    sides = []
    for mine, theirs in zip(_halves(trie.words, length), _halves(asked, length)):
        number = {h: i for i, h in enumerate(dict.fromkeys(mine))}
        key = trie.leaf * len(number) + np.array([number[h] for h in mine], np.int64)
        order = np.argsort(key, kind="stable")
        sides.append((len(number), key[order], order, np.array([number.get(h, -1) for h in theirs], np.int64), np.array([number[h] for h in mine], np.int64)))
    found = []
    for who, leaf, now in trie.search(counts, states):
        use = now != OWED
        who, leaf, now = who[use], leaf[use], now[use]
        for side, (total, keys, order, theirs, mine) in enumerate(sides):
            some = np.flatnonzero(theirs[who] >= 0)
            key = leaf[some] * total + theirs[who[some]]
            row, place = _spread(np.searchsorted(keys, key), np.searchsorted(keys, key, "right"))
            pairs = np.stack([who[some[row]], order[place], now[some[row]]])
            if side:  # others are found by the first half already
                pairs = pairs[:, sides[0][3][pairs[0]] != sides[0][4][pairs[1]]]
            step = max(1, COMPARED // (length + 1))
            for at in range(0, pairs.shape[1], step):
                part = pairs[:, at : at + step]
                size = np.array([len(asked[i]) for i in part[0]], np.int64)
                for width in (length, length + 1):
                    same = part[:, size == width]
                    if same.shape[1]:
                        ok = one_edit(_padded([asked[i] for i in same[0]], width), _padded([trie.words[j] for j in same[1]], length), length)
                        found.append(same[:, ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y, now = np.concatenate(found, axis=1)
    once = np.array([s == SPENT or asked[i] < trie.words[j] for i, j, s in zip(x, y, now)], bool)
    return x[once], trie.order[y[once]]


NEAR = "word string, n_near bigint, best_n bigint, best string"


def _searched(groups):
    """A node's words and those that search it: for each word how many near ones were found, and the most frequent of them."""

    def run(home: pa.Table, asked: pa.Table) -> pa.Table:
        level = (home if home.num_rows else asked)["level"][0].as_py()
        latin = lambda t: [w.encode("latin-1") for w in t["word"].to_pylist()]
        a, b = near_pairs(latin(home), latin(asked), asked["state"].to_numpy(), groups.value, level)
        ask, own = asked["word"].combine_chunks(), home["word"].combine_chunks()
        left = pa.concat_arrays([ask.take(pa.array(a)), own.take(pa.array(b))])
        right = pa.concat_arrays([own.take(pa.array(b)), ask.take(pa.array(a))])
        n = np.r_[home["n"].to_numpy()[b], asked["n"].to_numpy()[a]]
        pairs = pa.table({"word": left, "near": right, "n": pa.array(n)}).sort_by([("word", "ascending"), ("n", "descending"), ("near", "ascending")])
        words = pairs["word"].combine_chunks()
        first = np.flatnonzero(np.r_[True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]) if len(words) else np.zeros(0, np.int64)
        best = pairs.take(pa.array(first))
        return pa.table({"word": best["word"], "n_near": pa.array(np.diff(first, append=len(words)), pa.int64()), "best_n": best["n"], "best": best["near"]})

    return run


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        total += np.bincount(_flat([w.encode("latin-1") for w in batch["word"].to_pylist()])[0], minlength=256)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"letter": pa.array(at, pa.int32()), "n": pa.array(total[at])})


def _numbered(groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = group_counts([w.encode("latin-1") for w in batch["word"].to_pylist()], groups.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * GROUPS), pa.array(counts.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "counts"])

    return run


def near_words(found: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of (word, n), where a word has near ones: how many, and the most frequent, or of
    equally frequent ones the smallest. Words are different and of Latin-1 letters."""
    spark = found.sparkSession
    frequency = np.zeros(256)
    for letter, n in found.select("word").mapInArrow(_letters, "letter int, n bigint").groupBy("letter").agg(F.sum("n")).collect():
        frequency[letter] = n
    groups = spark.sparkContext.broadcast(letter_groups(frequency))
    counted = found.select("word", "n").mapInArrow(_numbered(groups), "word string, n bigint, counts array<int>")
    # A word searches the node of its own length, which has it too, and the one below.
    start = F.array(
        F.struct(F.char_length("word").cast("string").alias("node"), F.lit(SAME).alias("state")),
        F.struct((F.char_length("word") - 1).cast("string").alias("node"), F.lit(OWED).alias("state")),
    )
    rows = counted.select("*", F.inline(start))
    cells = None
    for level in range(GROUPS + 1):
        current = kept(rows, f"trie-{level}")
        home = F.col("state") == SAME
        letters = F.char_length("word").cast("bigint")
        nodes = materialize(
            current.groupBy("node").agg(F.sum(F.when(home, letters)).alias("held"), F.sum(letters).alias("asking")).filter("held is not null"), "trie-nodes", extremes="held", columnar=True,
        )
        # Searches of nodes without words end here.
        met = current.join(nodes.df, "node").withColumn("level", F.lit(level))
        last = level == GROUPS or nodes.most is None or nodes.most <= NODE
        small = met if last else met.filter(F.col("held") <= NODE)
        cells = small if cells is None else cells.unionByName(small)
        if last:
            break
        own = F.col("counts")[level]
        same = F.struct(own.alias("count"), F.col("state").alias("state"))
        steps = F.when(F.col("state") == SAME, F.array(same, F.struct((own + 1).alias("count"), F.lit(OWED).alias("state"))))
        steps = steps.when(F.col("state") == OWED, F.array(same, F.struct((own - 1).alias("count"), F.lit(SPENT).alias("state")))).otherwise(F.array(same))
        rows = met.filter(F.col("held") > NODE).select("node", "word", "n", "counts", F.inline(steps)).withColumn("node", F.concat_ws(".", "node", "count")).drop("count")
    # Many searches of one node are dealt out, and so are the words of a node that no level can part; each part of the ones meets
    # each of the others.
    parts = lambda c: F.ceil(F.greatest(F.col(c), F.lit(1)) / F.lit(NODE)).cast("bigint")
    at = lambda c, by: F.pmod(F.xxhash64(F.lit(by), "word"), parts(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), parts(c) - 1))
    both = ["node", "level", "word", "n", "state", "held", "asking"]
    cells = cells.select(*both)
    homes = cells.filter(F.col("state") == SAME).withColumn("home_part", at("held", "home")).withColumn("ask_part", every("asking"))
    # With columns of its own, so that the two sides are told apart.
    asked = cells.select(*[F.col(c).alias(c) for c in both]).withColumn("ask_part", at("asking", "ask")).withColumn("home_part", every("held"))
    key = ["node", "home_part", "ask_part"]
    near = homes.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_searched(groups), NEAR)
    # A word has a bounded number of words one edit away, and at most a row for each node it searches.
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best")))
    summed = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("first"))
    return summed.select("word", "n_near", (-F.col("first.n")).alias("best_n"), F.col("first.best").alias("best"))


# ---------------------------------------------------------------- forms


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each word's chain of forms. Chains are short, since counts grow by RATIO at each
    step; each round doubles the steps taken."""
    current = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = kept(current.join(further, "root", "left"), "roots")
        current = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.filter("next is not null").isEmpty():
            return current


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (doc_id, text); see ``words`` for what a word is.

    ``form`` is the most frequent near word (ties: the smallest) if it occurs RATIO times as often, ``root`` the last of the
    chain of forms. Null and empty texts have no words; a null doc_id counts as the empty text in the choice of
    letters to delete; repeated rows count each time; very long words are words like others. An empty table gives an
    empty one; columns other than doc_id and text are not looked at.
    """
    found = kept(words(docs), "words")
    near = near_words(found)
    known = found.join(near, "word", "left")
    has = F.col("best_n") >= RATIO * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    known = kept(known, "forms")
    ends = roots(known.filter("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
