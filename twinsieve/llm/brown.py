"""Language-model scores by Brown's class-based bigrams.

log P(text) is the sum of log P(class | class before) + log P(word | class). The classes start from units: a frequent
word is its own, the others share one by their ending. The exchange algorithm moves units between classes while that
raises the bigram likelihood of the training text. From there every word of the training texts, however rare, has an
exchange of its own: a sweep sums its left and right neighbours per class and takes the class that raises the
likelihood most while the other words stay; frequent words keep what their exchange found. All words move at once, so
from the second sweep on one that lowers the likelihood is taken back and ends the exchange. Only words never seen in training get their ending's class. Transitions are interpolated with
class frequencies; a class keeps the share of its once-seen words for unseen ones (Good-Turing).

Counts cover all words of all training documents and are made by Spark. Texts are dealt into chunks of bounded size,
in which a token is its word's place in the chunk, and words by their hash into buckets, more of them the more text
there is. A chunk asks once for each of its different words, the answers (count and class) meet its texts again in one
task, and so the vocabulary is never broadcast, however large. All that a chunk and a bucket tell each other is one row
of packed numbers, not a row for each word; a word itself goes to its bucket once, and is a number there from then on.
The driver sees the frequent words and sums per pair of units or classes: numbers bounded by parameters, not by the
corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ROWS, forgotten, kept, remainder, texts

CHUNK_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20  # text for each bucket of words
FREQUENT = 1024  # words that are units of their own
ENDINGS = 256  # units that the other words share
END = FREQUENT + ENDINGS  # the unit of the end token
CLASSES = 64  # besides the class of the end token
SWEEPS = 6  # of the exchange over all units
WORD_SWEEPS = 2  # of the exchange over all words
SMALL = 16  # neighbour counts below this have their gains looked up
GROUPS = 512  # words whose gains are computed at once, fewer if they have more neighbours than
ENTRIES = 8192
SHARED = 8.0  # weight of class frequencies in a transition
MEMO = 400_000


def tokens(text: str) -> list[bytes]:
    """Words in ASCII lower case, cut at ASCII white space."""
    return text.encode().lower().split()


class Units(dict):
    """Word to unit; holds the frequent words and remembers some of the others."""

    def __missing__(self, word: bytes) -> int:
        unit = FREQUENT + zlib.crc32(word[-3:]) % ENDINGS
        if len(self) < MEMO:
            self[word] = unit
        return unit


# ---------------------------------------------------------------- counting


class _Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def packed(codes: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers byte plane by byte plane, which compresses well."""
    return codes.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def unpacked(data: bytes, kind: str = "<i4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel().astype(np.int64)


LONG = "<i8"


def _joined(column: pa.ChunkedArray, kind: str = "<i4") -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(unpacked(data, kind) for data in column.to_pylist())])


def _cut(numbers: np.ndarray, bounds: np.ndarray, kind: str = "<i4") -> list[bytes]:
    return [packed(numbers[a:b], kind) for a, b in zip(bounds, bounds[1:])]


CODED = "chunk bigint, doc_id bigint, held_out boolean, codes binary, bucket int, words binary, n binary"


def _coded(buckets: int):
    """A row for each text, as its words' places in the chunk, and one for each bucket with words of the chunk: the words in
    the order of their places, each with a line end, and their training counts there (0: only in held-out texts). Places go
    on from bucket to bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, places = TaskContext.get().partitionId() << 32, 0, _Places()
        ids, held_out, found = [], [], []

        def rows(n, doc_ids, held, codes, numbers, words, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk] * n, pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array(held, pa.bool_()),
                "codes": pa.array(codes, pa.binary()), "bucket": pa.array(numbers, pa.int32()), "words": pa.array(words, pa.binary()),
                "n": pa.array(counts, pa.binary()),
            })

        def done() -> Iterator[pa.RecordBatch]:
            words = list(places)
            bucket = np.fromiter((zlib.crc32(word) % buckets for word in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words))
            counts = np.zeros(len(words), np.int64)
            for a in range(0, len(found), ROWS):
                codes, none = [place[at] for at in found[a : a + ROWS]], [None] * len(found[a : a + ROWS])
                for at, held in zip(codes, held_out[a:]):
                    if not held:
                        np.add.at(counts, at, 1)
                yield rows(len(codes), ids[a : a + ROWS], held_out[a : a + ROWS], [packed(at) for at in codes], none, none, none)
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            bounds, none = np.r_[first, len(words)], [None] * len(first)
            lines = [b"\n".join([*(words[i] for i in order[a:b]), b""]) for a, b in zip(bounds, bounds[1:])]
            yield rows(len(first), none, none, none, bucket[order][first], lines, _cut(counts, bounds))
            for each in (places, ids, held_out, found):
                each.clear()

        for batch in batches:
            for doc_id, length, held, text in zip(
                batch["doc_id"].to_pylist(), pa.compute.binary_length(batch["text"]).to_pylist(), batch["held_out"].to_pylist(), batch["text"]
            ):
                if size and size + length > CHUNK_BYTES:
                    yield from done()
                    chunk, size = chunk + 1, 0
                size += length
                words = tokens(text.as_py())
                ids.append(doc_id)
                held_out.append(held)
                found.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
        yield from done()

    return run


COUNTED = "chunk bigint, bucket int, numbers binary, c binary, unit binary, number int, word binary, n bigint, types bigint"


def _counted(rows: pa.Table) -> pa.Table:
    """A bucket's words as numbers, a row for each chunk: with their training counts in all chunks and the units of their
    endings. Beside these, rows of the words that may be frequent and a row with the number of words with a count."""
    lines = b"".join(rows["words"].to_pylist())
    ends = np.flatnonzero(np.frombuffer(lines, np.uint8) == 10) + 1
    offsets = np.r_[0, ends]
    coded = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(lines)]).dictionary_encode()
    number, words = coded.indices.to_numpy(), [line[:-1] for line in coded.dictionary.to_pylist()]
    parts = [unpacked(n) for n in rows["n"].to_pylist()]
    bounds = np.cumsum([0, *map(len, parts)])
    c = np.zeros(len(words), np.int64)
    np.add.at(c, number, np.concatenate(parts))
    unit = np.fromiter((FREQUENT + zlib.crc32(word[-3:]) % ENDINGS for word in words), np.int64, len(words))
    seen = np.flatnonzero(c)
    likely = seen[c[seen] >= np.partition(c[seen], -FREQUENT)[-FREQUENT]] if len(seen) > FREQUENT else seen
    top = sorted(likely.tolist(), key=lambda i: (-c[i], words[i]))[:FREQUENT]
    bucket = rows["bucket"][0].as_py()

    def table(length: int, **columns) -> pa.Table:
        return pa.table({
            name: pa.array(columns.get(name, [None] * length), {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind])
            for name, kind in (part.split() for part in COUNTED.split(", "))
        })

    return pa.concat_tables([
        table(len(parts), chunk=rows["chunk"].to_pylist(), bucket=[bucket] * len(parts), numbers=_cut(number, bounds),
              c=_cut(c[number], bounds, LONG), unit=_cut(unit[number], bounds, "<i2")),
        table(len(top), bucket=[bucket] * len(top), number=top, word=[words[i] for i in top], n=c[top]),
        table(1, bucket=[bucket], types=[len(seen)]),
    ])


Frequent = dict[int, tuple[np.ndarray, np.ndarray]]  # of a bucket: numbers of frequent words, ascending, and their units


def frequent_units(known: pa.Table, frequent: Frequent) -> np.ndarray:
    """The unit of each word that has one of its own, -1 for the others."""
    units = [np.zeros(0, np.int64)]
    for bucket, data in zip(known["bucket"].to_pylist(), known["numbers"].to_pylist()):
        numbers = unpacked(data)
        if bucket in frequent:
            at, own = frequent[bucket]
            found = np.minimum(np.searchsorted(at, numbers), len(at) - 1)
            units.append(np.where(at[found] == numbers, own[found], -1))
        else:
            units.append(np.full(len(numbers), -1))
    return np.concatenate(units)


def _units(known: pa.Table, frequent: Frequent) -> np.ndarray:
    own = frequent_units(known, frequent)
    return np.where(own >= 0, own, _joined(known["unit"], "<i2"))


def _flow(docs: pa.Table, end: int, kind: type = np.int32) -> np.ndarray:
    """All places of a chunk's texts, each text between ends."""
    codes = docs["codes"]
    flow = np.full((pa.compute.sum(pa.compute.binary_length(codes)).as_py() or 0) // 4 + len(codes) + 1, end, kind)
    at = 1
    for data in codes:
        places = unpacked(data.as_py())
        flow[at : at + len(places)] = places
        at += len(places) + 1
    return flow


BLOCK = 1 << 18  # numbers that are counted at once


def _occurrences(numbers: np.ndarray, length: int) -> np.ndarray:
    """How often each of ``length`` numbers occurs; ``bincount`` alone would widen all of them at once."""
    n = np.zeros(length, np.int64)
    for at in range(0, len(numbers), BLOCK):
        some = np.bincount(numbers[at : at + BLOCK])
        n[: len(some)] += some
    return n


PAIRS = "slice int, pairs binary, n binary"
SLICE = 1 << 15  # pairs of units that are added up by one task


def _sliced(pairs: np.ndarray, n: np.ndarray) -> pa.Table:
    """Counts of ascending pairs, a row for each slice of them."""
    first = np.flatnonzero(np.diff(pairs // SLICE, prepend=-1))
    bounds = np.r_[first, len(pairs)]
    return pa.table({
        "slice": pa.array(pairs[first] // SLICE, pa.int32()), "pairs": pa.array(_cut(pairs, bounds), pa.binary()),
        "n": pa.array(_cut(n, bounds, LONG), pa.binary()),
    })


def _bigrams(seed):
    def run(known: pa.Table, docs: pa.Table) -> pa.Table:
        units = np.r_[_units(known.sort_by("bucket"), seed.value), END].astype(np.int32)
        path = units[_flow(docs, len(units) - 1)]
        n = _occurrences(path[:-1] * (END + 1) + path[1:], (END + 1) ** 2)
        at = np.flatnonzero(n)
        return _sliced(at, n[at])

    return run


def _added(rows: pa.Table) -> pa.Table:
    pairs, inverse = np.unique(_joined(rows["pairs"]), return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, inverse, _joined(rows["n"], LONG))
    return _sliced(pairs, n)


# ---------------------------------------------------------------- classes


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(bigrams: np.ndarray, of: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes."""
    table = class_table(bigrams, of)
    return float(_g(table).sum() - _g(table.sum(1)).sum() - _g(table.sum(0)).sum())


def class_table(bigrams: np.ndarray, of: np.ndarray) -> np.ndarray:
    rows = np.zeros((CLASSES + 1, bigrams.shape[1]))
    np.add.at(rows, of, bigrams)
    table = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(table.T, of, rows.T)
    return table


def exchange(bigrams: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit. The end token keeps the last class for itself; unused units stay where they are."""
    of = np.arange(len(bigrams)) % CLASSES
    of[END] = CLASSES
    table = class_table(bigrams, of)
    out, into = bigrams.sum(1), bigrams.sum(0)
    order = np.argsort(-(out + into), kind="stable")
    order = order[(order != END) & ((out + into)[order] > 0)]
    for _ in range(sweeps):
        moved = 0
        for w in order:
            own, loop = of[w], bigrams[w, w]
            right = np.bincount(of, bigrams[w], CLASSES + 1)
            left = np.bincount(of, bigrams[:, w], CLASSES + 1)
            right[own] -= loop
            left[own] -= loop
            table[own] -= right
            table[:, own] -= left
            table[own, own] -= loop
            rows, columns = table.sum(1), table.sum(0)
            base, diagonal = _g(table), np.diagonal(table)
            gain = (_g(table + right) - base).sum(1) + (_g(table + left[:, None]) - base).sum(0)
            # The diagonal was counted in both sums, each time without the other's part.
            gain -= _g(diagonal + right) + _g(diagonal + left) - 2 * np.diagonal(base)
            gain += _g(diagonal + right + left + loop) - np.diagonal(base)
            gain -= _g(rows + out[w]) - _g(rows) + _g(columns + into[w]) - _g(columns)
            new = int(gain[:CLASSES].argmax())
            if gain[new] <= gain[own] + 1e-9:
                new = own
            table[new] += right
            table[:, new] += left
            table[new, new] += loop
            moved += new != own
            of[w] = new
        if not moved:
            break
    return of


def _known_classes(known: pa.Table, frequent: Frequent, of: np.ndarray) -> np.ndarray:
    """The class of each word: its own where it has one by now, else its unit's."""
    return _joined(known["cls"], "<u1") if "cls" in known.column_names else of[_units(known, frequent)]


ONCE = (CLASSES + 1) ** 2  # sums from here on are of once-seen words per class, those before of pairs of classes
NEIGHBOURS = "chunk bigint, bucket int, numbers binary, c binary, cls binary, sizes binary, keys binary, counts binary, sums binary"
CLASSED = "chunk bigint, bucket int, numbers binary, c binary, cls binary"


def _pieces(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``numbers``, cut at ``bounds``."""
    offsets = (bounds * numbers.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(numbers)])


def _in_bytes(keys: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as bytes: a larger one is given in parts, each with the key. ``bounds`` tell which belong together."""
    parts = (n + 254) // 255
    last = np.cumsum(parts)
    small = np.full(int(last[-1]) if len(last) else 0, 255, np.uint8)
    small[last - 1] = n - 255 * (parts - 1)
    return np.repeat(keys, parts), small, np.r_[0, last][bounds]


def _neighbours(seed, summed: bool):
    """A chunk's words, with their neighbours per class if ``summed``, and a row with its sums. Frequent words, which keep
    their classes, have no neighbours here."""

    def run(known: pa.Table, docs: pa.Table) -> pa.Table:
        size = CLASSES + 1
        known = known.sort_by("bucket")
        c = _joined(known["c"], LONG)
        words = len(c)
        cls = np.r_[_known_classes(known, *seed.value), CLASSES].astype(np.int32)
        # As narrow as the numbers allow: a chunk has millions of tokens.
        kind = np.int32 if (words + 1) * 2 * size < 1 << 31 else np.int64
        flow = _flow(docs, words, kind)
        path = cls[flow]
        own = _occurrences(flow, words + 1)[:-1]
        sums = np.r_[_occurrences(path[:-1] * size + path[1:], size * size), np.bincount(cls[:-1][(c == 1) & (own > 0)], minlength=size)]
        none = [None]
        parts = [pa.table({
            "chunk": pa.array(none, pa.int64()), "bucket": pa.array(none, pa.int32()),
            **{name: pa.array(none, pa.binary()) for name in ("numbers", "c", "cls", "sizes", "keys", "counts")},
            "sums": pa.array([packed(sums, LONG)], pa.binary()),
        })]
        if summed:
            stays = np.r_[frequent_units(known, seed.value[0]) >= 0, True]
            inner = np.flatnonzero(~stays[flow])
            both = np.empty(2 * len(inner), kind)
            both[: len(inner)] = flow[inner] * (2 * size) + path[inner - 1]
            both[len(inner) :] = flow[inner] * (2 * size) + size + path[inner + 1]
            del flow, path, inner
            both.sort()
            first = np.flatnonzero(np.diff(both, prepend=-1))
            n = np.diff(first, append=len(both))
            found = both[first]
            del both, first
            bounds = np.searchsorted(found, np.arange(words + 1, dtype=kind) * (2 * size))
            keys, n, bounds = _in_bytes((found % (2 * size)).astype(np.uint8), n, bounds)
            # From a place to a row's words: 8 bytes of ``c`` each.
            ends = np.r_[0, np.cumsum(pa.compute.binary_length(known["c"]).to_numpy() // 8)].astype(np.int64)
            parts.append(pa.table({
                **{name: known[name] for name in ("chunk", "bucket", "numbers", "c")}, "cls": pa.array(_cut(cls[:-1], ends, "<u1"), pa.binary()),
                "sizes": pa.array(_cut(np.diff(bounds), ends), pa.binary()), "keys": _pieces(keys, bounds[ends]), "counts": _pieces(n, bounds[ends]),
                "sums": pa.array([None] * known.num_rows, pa.binary()),
            }))
        return pa.concat_tables(parts)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(ONCE + CLASSES + 1, np.int64)
    for batch in batches:
        for data in batch["sums"].to_pylist():
            sums += unpacked(data, LONG)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int32()), "c": pa.array(sums[at])})


def best_classes(table: np.ndarray, own: np.ndarray, total: np.ndarray, word: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most while all other words stay.

    ``own`` and ``total`` are words' classes and counts; (word, key, n), ordered by word, are neighbours: keys up to
    CLASSES are classes on the left, the others on the right. Every word has some.
    """
    cells = np.vstack([table[:, :CLASSES], table[:CLASSES].T])
    base = _g(cells)
    small = np.stack([_g(cells + i) - base for i in range(SMALL)])
    sides = table.sum(1)[:CLASSES], table.sum(0)[:CLASSES]
    new = own.copy()
    starts = np.searchsorted(word, np.arange(len(own) + 1))
    last = 0
    while last < len(own):
        first = last
        last = min(max(int(np.searchsorted(starts, starts[first] + ENTRIES, "right")) - 1, first + 1), first + GROUPS, len(own))
        mine, count = own[first:last], total[first:last].astype(float)
        a, b = starts[first], starts[last]
        w, k, x = word[a:b] - first, key[a:b], n[a:b]
        change = small[np.minimum(x, SMALL - 1), k]
        large = np.flatnonzero(x >= SMALL)
        change[large] = _g(cells[k[large]] + x[large, None]) - base[k[large]]
        # Its own class has the word in it already.
        e = np.arange(len(w))
        change[e, mine[w]] = base[k, mine[w]] - _g(cells[k, mine[w]] - x)
        gain = np.add.reduceat(change, np.searchsorted(w, np.arange(len(mine))), axis=0)
        each = np.arange(len(mine))
        for side in sides:
            loss = _g(side + count[:, None]) - _g(side)
            loss[each, mine] = _g(side[mine]) - _g(side[mine] - count)
            gain -= loss
        best = gain.argmax(1)
        new[first:last] = np.where(gain[each, best] > gain[each, mine] + 1e-9, best, mine)
    return new


def _moved(seed, shared):
    """A bucket's words with new classes; frequent ones keep those of their own exchange."""

    def run(rows: pa.Table) -> pa.Table:
        at, all_c, cls = _joined(rows["numbers"]), _joined(rows["c"], LONG), _joined(rows["cls"], "<u1")
        words, width = int(at.max()) + 1, 2 * (CLASSES + 1)
        own, c, stay = np.zeros(words, np.int64), np.zeros(words, np.int64), np.zeros(words, bool)
        own[at], c[at], stay[at] = cls, all_c, frequent_units(rows, seed.value[0]) >= 0
        del all_c, cls
        taken = np.flatnonzero((c > 0) & ~stay)
        # Word, key and count in one number, to be sorted.
        found = np.repeat(at, _joined(rows["sizes"])) * width
        found += np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint8)
        found <<= 8
        found |= np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint8)
        found.sort()
        if len(taken):
            first = np.flatnonzero(np.diff(found >> 8, prepend=-1))
            n = np.add.reduceat(found & 255, first)
            found = found[first] >> 8
            own[taken] = best_classes(shared.value, own[taken], c[taken], np.searchsorted(taken, found // width), found % width, n)
        ends = np.r_[0, np.cumsum(pa.compute.binary_length(rows["c"]).to_numpy() // 8)]
        new = pa.array(_cut(own[at], ends, "<u1"), pa.binary())
        return rows.select(["chunk", "bucket", "numbers", "c"]).append_column("cls", new)

    return run


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, cls in zip(batch["words"].to_pylist(), batch["cls"].to_pylist()):
            yield pa.RecordBatch.from_pydict({"word": pa.array(words.split(b"\n")[:-1], pa.binary()), "cls": pa.array(unpacked(cls, "<u1"), pa.int32())})


class Words(NamedTuple):
    """The words of all chunks, with counts and units or classes: a row for each chunk and bucket."""

    rows: DataFrame
    spelt: DataFrame  # (chunk, bucket, words)

    def distinct(self) -> DataFrame:
        """A row for each word, with its class."""
        rows = self.rows.select("chunk", "bucket", "cls").join(self.spelt, ["chunk", "bucket"])
        return rows.select("words", "cls").mapInArrow(_spelt, "word binary, cls int").distinct()


def word_classes(known: Words, train: DataFrame, frequent: Frequent, of: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of each chunk with their classes (as yet those of their units if there is no ``cls``), the table of
    classes and the once-seen words of each class."""
    context, size = train.sparkSession.sparkContext, CLASSES + 1
    seed = context.broadcast((frequent, of))
    best = before = None
    for sweep in range(WORD_SWEEPS + 1):
        summed = sweep < WORD_SWEEPS
        met = known.rows.groupBy("chunk").cogroup(train.groupBy("chunk")).applyInArrow(_neighbours(seed, summed), NEIGHBOURS)
        if summed:
            met = kept(met, "neighbours")
        sums = np.zeros(ONCE + size)
        parts = met.filter("sums is not null").select("sums").mapInArrow(_summed, "place int, c bigint")
        for at, n in parts.groupBy("place").agg(F.sum("c")).collect():
            sums[at] = n
        table, once = sums[:ONCE].reshape(size, size), sums[ONCE:]
        if sweep > 1 and likelihood(table, np.arange(size)) < likelihood(best[1], np.arange(size)):
            break
        if before is not None:
            forgotten(before)  # the classes that could have been gone back to
        best, before = (known, table, once), known.rows
        if summed:
            moved = met.filter("bucket is not null").drop("sums").groupBy("bucket").applyInArrow(_moved(seed, context.broadcast(table)), CLASSED)
            known = known._replace(rows=kept(moved, "word-classes"))
            forgotten(met)
    return best


class Model(NamedTuple):
    frequent: dict[bytes, int]
    of: np.ndarray  # class of each unit
    transition: np.ndarray  # log10, (class before, class)
    total: np.ndarray  # training tokens of each class
    unseen: np.ndarray  # share of each class that is kept for unseen words
    tokens: int
    types: int
    documents: int


def model_of(frequent: dict[bytes, int], bigrams: np.ndarray, n: np.ndarray, once: np.ndarray, types: int) -> Model:
    """Probabilities from sums per unit and pair of units; the end token's count is in ``n``."""
    of = exchange(bigrams)
    return class_model(frequent, of, class_table(bigrams, of), np.bincount(of, n, CLASSES + 1), np.bincount(of, once, CLASSES + 1), types)


def class_model(frequent: dict[bytes, int], of: np.ndarray, table: np.ndarray, total: np.ndarray, once: np.ndarray, types: int) -> Model:
    """Probabilities from the table of classes and the tokens and once-seen words of each."""
    share = (total + 0.5) / (total.sum() + 0.5 * (CLASSES + 1))
    transition = (table + SHARED * share) / (table.sum(1, keepdims=True) + SHARED)
    unseen = (once + 0.5) / (total + 1)
    documents = int(total[CLASSES])
    unseen[CLASSES] = 0.0 if documents else 1.0  # the end token is the only one of its class
    return Model(frequent, of, np.log10(transition), total, unseen, int(total.sum()), types, documents)


# ---------------------------------------------------------------- scores


def word_columns(words: list[bytes], counts: np.ndarray, model: Model, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Count, class, log10 P(word | class) and base log10 probability of words; the end token is put behind them.

    ``own`` has the classes of words with a count; the others, or all without it, have their units' classes.
    """
    units = Units(model.frequent)
    cls = model.of[np.fromiter(map(units.__getitem__, words), np.int64, len(words))] if words else np.zeros(0, np.int64)
    if own is not None:
        cls = np.where(counts > 0, own, cls)
    return class_columns(counts, cls, model)


def class_columns(counts: np.ndarray, cls: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """``word_columns`` of words whose classes are known."""
    cls, counts = np.r_[cls, CLASSES].astype(np.int64), np.r_[counts, model.documents].astype(np.int64)
    seen = (1 - model.unseen[cls]) * counts / np.maximum(model.total[cls], 1)
    emission = np.log10(np.where(counts > 0, seen, model.unseen[cls]))
    base = np.log10((counts + 1) / (model.tokens + model.types + 1))
    return counts, cls, emission, base


def text_scores(codes: np.ndarray, columns: tuple[np.ndarray, ...], model: Model) -> tuple[int, int, float, float]:
    """Tokens, known tokens, base score and score of one text, given as its words' places in ``columns``."""
    counts, cls, emission, base = columns
    at = np.r_[codes, len(counts) - 1]
    path = cls[at]
    before = np.r_[CLASSES, path[:-1]]
    score = emission[at].sum() + model.transition[before, path].sum()
    return len(at), int((counts[at] > 0).sum()), float(base[at].sum()), float(score)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"


def _scored(model, seed):
    def run(known: pa.Table, docs: pa.Table) -> pa.Table:
        m = model.value
        known = known.sort_by("bucket")
        columns = class_columns(_joined(known["c"], LONG), _known_classes(known, *seed.value), m)
        found = [text_scores(unpacked(codes.as_py()), columns, m) for codes in docs["codes"]]
        n, known, base, score = (np.array(x) for x in zip(*found)) if found else [np.zeros(0)] * 4
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([m.tokens] * len(found), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
            "perplexity": pa.array(10.0 ** (-score / np.maximum(n, 1)), pa.float64()),
        })

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of every row of (doc_id, text, held_out), learnt from the rows that are not held out.

    ``n_known`` counts tokens with a training count, ``base_score`` is the add-one unigram's log10 probability and
    ``score`` the class model's. A null text counts as empty and has the end token alone. Repeated rows and null
    doc_ids give a row each; without training rows every token is unseen; an empty table gives an empty one.
    """
    context = docs.sparkSession.sparkContext
    rows = texts(docs, "held_out")
    size, documents = rows.agg(F.sum(F.octet_length("text").cast("bigint")), F.count_if(~F.col("held_out"))).first()
    staged = kept(rows.mapInArrow(_coded((size or 0) // BUCKET_BYTES + 1), CODED), "chunks")
    coded = staged.filter("codes is not null").select("chunk", "doc_id", "held_out", "codes")
    train = coded.filter(~F.col("held_out")).select("chunk", "codes")
    asked = staged.filter("words is not null").select("chunk", "bucket", "words", "n")
    answers = kept(asked.groupBy("bucket").applyInArrow(_counted, COUNTED), "word-counts")
    types = answers.agg(F.sum("types")).first()[0] or 0
    top = answers.filter("word is not null").select("word", "n", "bucket", "number").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent: Frequent = {}
    for bucket in {r.bucket for r in top}:
        frequent[bucket] = tuple(np.array(sorted((r.number, i) for i, r in enumerate(top) if r.bucket == bucket)).T)
    known = Words(answers.filter("numbers is not null").select("chunk", "bucket", "numbers", "c", "unit"), asked.select("chunk", "bucket", "words"))
    met = known.rows.groupBy("chunk").cogroup(train.groupBy("chunk")).applyInArrow(_bigrams(context.broadcast(frequent)), PAIRS)
    pairs = met.groupBy("slice").applyInArrow(_added, PAIRS).toArrow()
    bigrams = np.zeros((END + 1) ** 2)
    bigrams[_joined(pairs["pairs"])] = _joined(pairs["n"], LONG)
    of = exchange(bigrams.reshape(END + 1, END + 1))
    known, table, once = word_classes(known, train, frequent, of)
    model = class_model({bytes(r.word): i for i, r in enumerate(top)}, of, table, table.sum(0), once, types + (documents > 0))
    scored = _scored(context.broadcast(model), context.broadcast((frequent, of)))
    return known.rows.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(scored, SCORES)


def score_split(docs: DataFrame) -> DataFrame:
    """``score_documents`` with the rows held out whose crc32 of doc_id is 2 modulo 7."""
    return score_documents(docs.select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out")))
