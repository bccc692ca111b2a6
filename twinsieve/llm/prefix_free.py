"""Collocations, counted on a prefix-free parse.

A text is cut in front of its trigger words, which are chosen by a hash of the word alone. A chunk goes on for up to
LONGEST - 1 words behind its end, so that every phrase lies whole in some chunk, and owns the phrases that begin before
its end, so that the words in which chunks overlap count once. Equal passages are cut equally wherever they stand:
the different chunks form a dictionary with the number of times each was parsed, and phrases are counted inside the
dictionary's chunks, weighted by these numbers, not in the texts.

Words and pairs are counted by 64-bit hash first. Equal hashes only add up, so what stays below the least count there is no
candidate nor part of one, and of longer phrases only those need counting whose pairs are all left. A bit table
of those hashes is made in slices, one by one in the tasks, and sent to them all. It grows with the hashes' measured number up
to a fixed size; from there it lets more phrases through that are not frequent, and far beyond that all phrases are counted.
Either way the counts that follow are of the words themselves and exact, and a task holds a bounded number of chunks and counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .base import kept

LONGEST = 3  # words of a phrase, at most
TRIGGER = 16  # one different word in so many begins a chunk
LEAST = 10  # occurrences of a candidate
SHARE = 50  # percent of a phrase's occurrences in one longer phrase that take it out
TOP = 2000  # phrases reported for each language
NO_LANG = "und"
SCANNED = 2 << 20  # bytes of text that are scanned at once
HELD = 4 << 20  # bytes of chunks whose phrases a task counts at once; it has some 40 times as much in memory
GIVEN = 1 << 16  # counts that a task hands over at once
PARTS = 16  # in which a language's phrases are ranked first
HASHES = 64 << 20  # hashes in a bit table that is sent to the tasks, at most
WIDTH = 28  # first bits of a hash that have a bit in the table, at most; it has 32 MB then
SLICES = 6  # first bits of the hashes that are in one slice of the table

SPACE, END = 32, 10
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_CAPITALS + _ENDS + b"\t", _CAPITALS.lower() + b"\n" * len(_ENDS) + b" ")
_FAR = 255  # bytes of a word from here on share a factor
_FACTORS = np.cumprod(np.full(_FAR + 1, 0x9E3779B97F4A7C15, np.uint64))


class Words(NamedTuple):
    row: np.ndarray  # of the text that a word is in
    start: np.ndarray  # its first byte, counted from its text's
    hash: np.ndarray  # 64 bits of its bytes
    joined: np.ndarray  # whether it follows the word before in one piece


def mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def scanned(data: np.ndarray, bounds: np.ndarray) -> Words:
    """The words of texts that lie one behind the other; words end at spaces, pieces at line ends."""
    parts, first = [], 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SCANNED, "right")) - 1)
        parts.append(_scanned(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], first))
        first = last
    return Words(*(np.concatenate(x) for x in zip(*parts))) if parts else Words(*(np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint64, bool)))


def _scanned(data: np.ndarray, bounds: np.ndarray, first_row: int) -> Words:
    end = data == END
    inside = ~(end | (data == SPACE))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[heads] = inside[heads]
    start = np.flatnonzero(first)
    if not len(start):
        return Words(*(np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint64, bool)))
    far = np.arange(start[0], len(data), dtype=np.int32) - np.repeat(start, np.diff(start, append=len(data))).astype(np.int32)
    value = _FACTORS[np.minimum(far, _FAR)] * (data[start[0] :].astype(np.uint64) + np.uint64(1))
    value[~inside[start[0] :]] = 0
    h = mixed(np.add.reduceat(value, start - start[0]))
    row = np.searchsorted(bounds, start, "right") - 1
    ends = np.cumsum(end, dtype=np.int32)[start]
    joined = np.r_[False, (row[1:] == row[:-1]) & (ends[1:] == ends[:-1])]
    return Words(row + first_row, start - bounds[row], h, joined)


def _bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of binary values, one behind the other, and where each begins and the last one ends."""
    if not len(texts):
        return b"", np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None else b""), offsets - offsets[0]


def chunks(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The chunks of texts, given as binary values: the row that each is in, its bytes and the number of its words that stand
    behind its end."""
    data, bounds = _bytes(texts)
    data = data.translate(_PLAIN)
    words = scanned(np.frombuffer(data, np.uint8), bounds)
    n = len(words.row)
    if not n:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    new = np.r_[True, words.row[1:] != words.row[:-1]]
    first = np.flatnonzero(new | ((words.hash >> np.uint64(32)) % np.uint64(TRIGGER) == 0))
    row = words.row[first]
    after = np.r_[first[1:], n]
    last = np.searchsorted(words.row, row, "right")  # words up to the end of the text
    reach = np.minimum(after + LONGEST - 1, last)
    begin = bounds[words.row] + words.start
    # Up to the next word, or to the end of the text.
    stop = np.where(reach < last, np.r_[begin, len(data)][reach], bounds[row + 1])
    return row, [data[a:b] for a, b in zip(begin[first].tolist(), stop.tolist())], reach - after


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Rows whose values in ``column`` have at most ``most`` bytes together, or one row that has more, and their bytes."""
    ends = np.r_[0, np.cumsum(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False))] if batch.num_rows else np.zeros(1)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield batch.slice(first, last - first), int(ends[last] - ends[first])
        first = last


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _ in _slices(batch, "text", 2 * SCANNED):
            row, found, behind = chunks(part["text"])
            yield pa.RecordBatch.from_pydict({
                "lang": part["lang"].take(pa.array(row)), "chunk": pc.ascii_rtrim_whitespace(pa.array(found, pa.binary()).cast(pa.string())), "behind": pa.array(behind, pa.int32()),
            })


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, behind, n): the different chunks of (text, lang), with the number of times each was parsed."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    found = rows.mapInArrow(_parsed, "lang string, chunk string, behind int")
    return found.groupBy("lang", "chunk", "behind").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- counting


class _Held(NamedTuple):
    """Chunks that are counted together."""

    langs: pa.Array
    lang: np.ndarray  # of each word, as a place in langs
    words: Words
    times: np.ndarray  # of each word's chunk; 0 where another chunk owns the word

    def follows(self, size: int) -> np.ndarray:
        """Where phrases of ``size`` words begin."""
        found = np.ones(len(self.times), bool)
        for k in range(1, size):
            found[: len(found) - k] &= self.words.joined[k:]
            found[len(found) - k :] = False
        return found

    def hashes(self) -> np.ndarray:
        """Of each word and its language."""
        of = np.array([xxhash.xxh64_intdigest(lang) for lang in self.langs.to_pylist()], np.uint64)
        return mixed(self.words.hash + of[self.lang]) if len(of) else self.words.hash

    def pairs(self, h: np.ndarray) -> np.ndarray:
        """Of each word and the next; at the end of a piece it means nothing."""
        return mixed(h + np.uint64(0x94D049BB133111EB)) + np.r_[h[1:], h[:1]]


def _held(rows: pa.Table) -> _Held:
    lang = rows["lang"].combine_chunks().dictionary_encode()
    data, bounds = _bytes(rows["chunk"].combine_chunks())
    words = scanned(np.frombuffer(data, np.uint8), bounds)
    count = np.bincount(words.row, minlength=rows.num_rows)
    place = np.arange(len(words.row)) - (np.cumsum(count) - count)[words.row]
    mine = place < (count - rows["behind"].to_numpy())[words.row]
    return _Held(lang.dictionary, lang.indices.to_numpy()[words.row], words, np.where(mine, rows["n"].to_numpy()[words.row], 0))


def _by_held(make: Callable[[_Held, pa.Table], Iterator[pa.Table]]):
    """Apply ``make`` to the chunks of a dictionary, many at a time."""

    def given(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        for found in make(_held(table), table):
            yield from found.to_batches(GIVEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for part, more in _slices(batch, "chunk", HELD):
                if rows and size + more > HELD:
                    yield from given(rows)
                    rows, size = [], 0
                rows.append(part)
                size += more
        if rows:
            yield from given(rows)

    return run


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their numbers; most numbers are 1, and those need no order of places."""
    once = np.sort(key[n == 1])
    first = np.flatnonzero(np.r_[True, once[1:] != once[:-1]]) if len(once) else np.zeros(0, np.int64)
    more, inverse = np.unique(key[n > 1], return_inverse=True)
    found = np.r_[once[first], more]
    sums = np.r_[np.diff(first, append=len(once)), np.bincount(inverse, n[n > 1], len(more)).astype(np.int64)]
    return found, sums


def _hash_counts(held: _Held, rows: pa.Table) -> Iterator[pa.Table]:
    h = held.hashes()
    two = held.follows(2)
    for key, times in ((h, held.times), (held.pairs(h)[two], held.times[two])):
        found, n = _summed(key, times)
        yield pa.table({"h": pa.array(found.view(np.int64)), "n": pa.array(n)})


class Likely(NamedTuple):
    """A bit for each value of a hash's first bits, with at least 32 bits for each hash as long as WIDTH allows."""

    bits: np.ndarray
    shift: np.uint64

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)


def _width(hashes: int) -> int:
    return min(WIDTH, max(SLICES + 3, int(32 * max(1, hashes) - 1).bit_length()))


def _bits(hashes: np.ndarray, width: int) -> np.ndarray:
    at = (hashes >> np.uint64(64 - width)).astype(np.int64)
    bits = np.zeros(1 << (width - 3), np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def likely_of(hashes: np.ndarray) -> Likely:
    width = _width(len(hashes))
    return Likely(_bits(hashes, width), np.uint64(64 - width))


def likely_among(found: DataFrame, rows: int) -> Likely:
    """The table of ``rows`` hashes in column h; tasks make a slice each, so no hash comes to the driver."""
    width, skipped = _width(rows), SLICES

    def slice_of(key: tuple[pa.Scalar], hashes: pa.Table) -> pa.Table:
        h = hashes["h"].to_numpy().view(np.uint64) << np.uint64(skipped)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([_bits(h, width - skipped).tobytes()], pa.binary())})

    of = F.shiftrightunsigned("h", 64 - SLICES).cast("int").alias("slice")
    made = found.select("h", of).groupBy("slice").applyInArrow(slice_of, "slice int, bits binary").toArrow()
    bits = np.zeros((1 << SLICES, 1 << (width - SLICES - 3)), np.uint8)
    for number, part in zip(made["slice"].to_pylist(), made["bits"]):
        bits[number] = np.frombuffer(part.as_buffer(), np.uint8)
    return Likely(bits.reshape(-1), np.uint64(64 - width))


def _phrase_counts(likely):
    """Counts of the phrases that ``likely`` does not rule out, and of all words of each language."""

    def make(held: _Held, rows: pa.Table) -> Iterator[pa.Table]:
        words = pc.list_flatten(pc.ascii_split_whitespace(rows["chunk"].combine_chunks().cast(pa.string())))
        coded = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
        ids, texts = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        alive, pairs = np.ones(len(ids), bool), None
        if likely is not None:
            h = held.hashes()
            alive, pairs = likely.value.has(h), likely.value.has(held.pairs(h))
        total = max(1, len(texts))
        group, heads = held.lang.astype(np.int64), np.zeros((len(held.langs), 0), np.int64)
        for size in range(1, LONGEST + 1):
            if size > 1 and pairs is not None:
                # A false positive of the table may stand behind a word that is ruled out.
                alive &= np.r_[pairs[size - 2 :], np.zeros(size - 2, bool)][: len(ids)]
            at = np.flatnonzero(alive & held.follows(size))
            # A phrase's number is that of its words but the last, followed by the last.
            found, inverse = np.unique(group[at] * total + ids[at + size - 1], return_inverse=True)
            before = found // total
            group = np.zeros(len(ids), np.int64)
            group[at] = inverse
            heads = np.c_[heads[before] if size > 1 else before[:, None], found % total]
            n = np.bincount(inverse, held.times[at], len(found)).astype(np.int64)
            some = np.flatnonzero(n)
            parts = [texts.take(pa.array(column[some])) for column in heads[:, 1:].T]
            yield pa.table({
                "lang": held.langs.take(pa.array(heads[some, 0])), "phrase": pc.binary_join_element_wise(*parts, " "),
                "size": pa.array(np.full(len(some), size, np.int32)), "n": pa.array(n[some]),
            })
        sums = np.bincount(held.lang, held.times, len(held.langs)).astype(np.int64)
        yield pa.table({
            "lang": held.langs, "phrase": pa.array([""] * len(held.langs), pa.string()), "size": pa.array([0] * len(held.langs), pa.int32()), "n": pa.array(sums),
        })

    return make


def phrase_counts(parsed: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, n): phrases of up to LONGEST words that occur at least ``least`` times; the empty phrase stands
    for all word occurrences of a language."""
    rows = parsed.select("lang", F.col("chunk").cast("binary").alias("chunk"), "behind", "n")
    hashed = rows.mapInArrow(_by_held(_hash_counts), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    found = materialize(hashed.filter(F.col("n") >= least).select("h"), "likely", columnar=True)
    likely = None
    if found.rows <= HASHES:
        likely = parsed.sparkSession.sparkContext.broadcast(likely_among(found.df, found.rows))
    counts = rows.mapInArrow(_by_held(_phrase_counts(likely)), "lang string, phrase string, size int, n bigint")
    return counts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("size") == 0))


# ---------------------------------------------------------------- scores


def cut_score(a: str, l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)), exactly for counts below 10^15; it is at most 1000000 as a is at most l and r."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"cast(({wide(a)} * {wide(a)} * cast(1000000 as decimal(7, 0))) div ({wide(l)} * {wide(r)}) as bigint)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language of (text, lang).

    Null texts are empty, a null lang is ``und``, and repeated rows count each time. Ties of a score go to the larger count,
    then to the smaller phrase by bytes. Very long pieces are cut like others. An empty table, or one without a phrase
    that occurs ``least`` times, gives an empty one; columns other than text and lang are not looked at.
    """
    counts = materialize(phrase_counts(kept(dictionary(docs), "parse"), least), "phrases", columnar=True).df
    phrases = counts.filter("size > 1").withColumnRenamed("n", "a")
    first = F.expr("substring_index(phrase, ' ', k)")
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumn("left_part", first).withColumn("right_part", F.expr("substring(phrase, char_length(left_part) + 2)"))
    for side, count in (("left_part", "l"), ("right_part", "r")):
        parts = counts.filter(F.col("size").between(1, LONGEST - 1)).select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
        # Counts have one row for each part, so the phrases of a hot part can be split over tasks.
        cuts = cuts.join(parts, ["lang", side])
    scored = cuts.withColumn("score", cut_score("a", "l", "r"))
    lowest = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every phrase inside a longer one is the longer one without its first or its last word, or inside such a phrase.
    inner = F.array(
        F.expr("struct(substring_index(phrase, ' ', size - 1) as inner_phrase, size - 1 as inner_size)"),
        F.expr("struct(substring_index(phrase, ' ', 1 - size) as inner_phrase, size - 1 as inner_size)"),
    )
    around = phrases.filter("size > 2").select("lang", "a", F.inline(inner)).groupBy("lang", "inner_phrase").agg(F.max("a").alias("longer"))
    joined = lowest.join(around.withColumnRenamed("inner_phrase", "phrase"), ["lang", "phrase"], "left")
    free = joined.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    # A language's best are among the best of its parts; so one task ranks a bounded number, however many phrases there are.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    likely = free.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top)
    ranked = likely.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


SQL = f"""
    WITH p AS (
        SELECT coalesce(lang, '{NO_LANG}') AS lang,
            unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents WHERE text IS NOT NULL
    ),
    w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM p),
    g AS (
        SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
        FROM w, (VALUES (1), (2), (3)) AS s(size)
    ),
    c AS (SELECT lang, phrase, size, count(*) AS n FROM g GROUP BY ALL),
    f AS (SELECT * FROM c WHERE n >= {LEAST}),
    t AS (SELECT lang, sum(n)::BIGINT AS n FROM c WHERE size = 1 GROUP BY lang),
    cut AS (
        SELECT lang, phrase, size, n AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
        FROM f, (VALUES (1), (2)) AS s(k) WHERE k < size
    ),
    scored AS (
        SELECT cut.*, x.n AS l, y.n AS r, ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
        FROM cut JOIN f AS x ON cut.lang = x.lang AND head = x.phrase JOIN f AS y ON cut.lang = y.lang AND rest = y.phrase
    ),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, unnest([head, rest]) AS phrase, a FROM cut WHERE size = 3),
    around AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
    ranked AS (
        SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
        FROM lowest LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * a
    )
    SELECT lang, rank, phrase, a, l, r, t.n, score FROM ranked JOIN t USING (lang) WHERE rank <= {TOP}"""
