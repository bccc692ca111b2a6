"""Packing token sequences: vector bin packing by the dot-product heuristic.

A sequence has simultaneous limits on tokens, on segments and on loss-bearing tokens. One sequence is open at
a time; of the pieces that fit in every dimension, the one with the largest weighted dot product of its
demands and the room left goes in next. Pieces with equal demands are interchangeable, so a choice
looks at each distinct demand once. Where distinct demands can be put in an order in which no dimension ever falls, as
when every token bears loss, a later one that fits has the larger product, and a choice is a binary search.

A document is cut only where it fills a sequence by itself: whole multiples of the token limit, and a rest that
is packed uncut. Pieces are dealt evenly over tasks, and each task packs blocks of bounded size.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .base import by_batch, texts

# Pieces packed together; a block's last sequence is the only one that stays open for want of pieces.
BLOCK = 16_384
TASK_PIECES = 4 * BLOCK
MEMO = 400_000
# White space as the tokenizer's pattern has it; the word part of each match is cut further by the tokenizer.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Limits(NamedTuple):
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048


class Ids:
    """A tokenizer in this worker, with the ids of runs seen before.

    A byte-level tokenizer with the usual pattern never joins anything across the runs of ``RUN``, so each
    distinct run is tokenized once; where its merges are in the order of its ids, as in rank files, by the faster of the two
    libraries that read them. Texts with an added token in them, and other tokenizers, go in whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        cut = described.get("pre_tokenizer") or {}
        self.by_run = (
            described.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        )
        self.added = [t["content"] for t in described.get("added_tokens", [])]
        self.memo: dict[str, bytes] = {}
        self.ranked = _ranked(described["model"]) if self.by_run else None

    def _tokenized(self, batch: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def packed(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        whole = [i for i, t in enumerate(batch) if not self.by_run or any(a in t for a in self.added)]
        apart = dict(zip(whole, self._tokenized([batch[i] for i in whole])))
        runs = [[] if i in apart else RUN.findall(t) for i, t in enumerate(batch)]
        if len(self.memo) > MEMO:
            self.memo.clear()
        fresh = list(set(chain.from_iterable(runs)).difference(self.memo))
        if self.ranked is None:
            self.memo.update(zip(fresh, self._tokenized(fresh)))
        else:
            encode = self.ranked.encode_ordinary
            self.memo.update((run, _packed(encode(run))) for run in fresh)
        known = self.memo.__getitem__
        return [apart[i] if i in apart else b"".join(map(known, r)) for i, r in enumerate(runs)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _ranked(model: dict):
    """The same merges as a rank table, or None if ids and merges are not in one order."""
    import tiktoken
    from public_tokenizers import PATTERN

    # How byte-level vocabularies spell bytes: printable ones as they are, the others from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    usual = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    if not usual or any(vocabulary.get("".join(m)) != 256 + i for i, m in enumerate(merges)) or not all(set(t) <= spelt.keys() for t in vocabulary):
        return None
    ranks = {bytes(spelt[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("runs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path)


def _cut(columns, path, end_id, most):
    end = int(end_id).to_bytes(4, "little")
    keys = columns["doc_id"].to_pylist()
    out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
    for key, ids in zip(keys, ids_of(path).packed(columns["text"].to_pylist())):
        ids += end
        tokens = len(ids) // 4
        for start in range(0, tokens, most):
            part = ids[4 * start : 4 * (start + most)]
            for name, value in zip(out, (key, start, len(part) // 4, zlib.crc32(part), tokens)):
                out[name].append(value)
    return out


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits()) -> DataFrame:
    """Pieces of each document's ids with ``end_id`` behind them: doc_id, start, length, ids_crc32, doc_tokens.

    A null text counts as empty: its one piece is the end id. Repeated rows and null doc_ids are packed like
    any other row; columns other than doc_id and text are not looked at.
    """
    most = min(limits.tokens, limits.loss_tokens)
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return by_batch(texts(docs), _cut, schema, tokenizer, end_id, most)


def fill(demands: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The bin of each item. A bin takes items while any fits; an item too large for an empty bin gets its own."""
    kinds, kind = np.unique(demands, axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    left = np.bincount(kind, minlength=len(kinds))
    taken = np.r_[0, np.cumsum(left)[:-1]]
    if (kinds >= 0).all() and (np.diff(kinds, axis=0) >= 0).all():
        bins = np.empty(len(demands), np.int64)
        bins[order] = _fill_chain(kinds, left, capacity)
        return bins
    share = kinds / capacity
    # A dimension weighs what all the items together ask of it.
    weighted = share * (left @ share)
    bins = np.empty(len(demands), np.int64)
    alive = np.arange(len(kinds))
    current, rest = 0, capacity.astype(np.int64)
    opened = False
    while len(alive):
        fits = (kinds[alive] <= rest).all(1)
        if fits.any():
            score = np.where(fits, weighted[alive] @ (rest / capacity), -1.0)
            pick = alive[score.argmax()]
        elif opened:
            current, rest, opened = current + 1, capacity.astype(np.int64), False
            continue
        else:
            pick = alive[0]  # fits nowhere
        bins[order[taken[pick]]] = current
        taken[pick] += 1
        left[pick] -= 1
        rest = rest - kinds[pick]
        opened = True
        if not left[pick]:
            alive = alive[alive != pick]
    return bins


def _fill_chain(kinds: np.ndarray, left: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """``fill`` for kinds of which each asks at least as much as the one before in every dimension: the last that fits is
    the choice. Bins come kind by kind, ``left`` of each."""
    columns, rows = kinds.T.tolist(), kinds.tolist()
    full = [int(c) for c in capacity]
    counts = left.tolist()
    bins: list[list[int]] = [[] for _ in rows]
    before = list(range(-1, len(rows) - 1))  # a kind that has not run out, or one on the way to it
    alive = sum(counts)

    def last(at: int) -> int:
        found = at
        while found >= 0 and not counts[found]:
            found = before[found]
        while at >= 0 and not counts[at]:
            before[at], at = found, before[at]
        return found

    current, rest, opened = 0, full, False
    while alive:
        pick = last(min(map(bisect.bisect_right, columns, rest)) - 1)
        if pick < 0:
            if opened:
                current, rest, opened = current + 1, full, False
                continue
            pick = next(i for i, n in enumerate(counts) if n)  # fits nowhere
        bins[pick].append(current)
        counts[pick] -= 1
        alive -= 1
        rest = [a - b for a, b in zip(rest, rows[pick])]
        opened = True
    return np.fromiter(chain.from_iterable(bins), np.int64)


def pack(pieces: DataFrame, limits: Limits = Limits(), loss: str = "length") -> DataFrame:
    """``pieces`` (with ``length`` and the ``loss`` column) plus sequence_id and offset.

    Offsets in a sequence are gapless from 0. A piece over a limit by itself gets a sequence of its own. Ties go
    to the smaller demand, then to the piece that sorts first by all columns.
    """
    written = materialize(pieces, "pieces", columnar=True)
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    capacity = np.array(limits, np.int64)

    def packed(batch: pa.Table, first: int) -> tuple[pa.RecordBatch, int]:
        length = batch["length"].to_numpy()
        demands = np.stack([length, np.ones_like(length), batch[loss].to_numpy()], 1)
        bins = fill(demands, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        begins = ends - length[order]
        new = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = begins - np.maximum.accumulate(np.where(new, begins, 0))
        taken = batch.take(pa.array(order)).append_column("sequence_id", pa.array(first + bins[order])).append_column("offset", pa.array(offset))
        return taken.combine_chunks().to_batches()[0], first + int(bins.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - rows)
                waiting.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == BLOCK:
                    out, first = packed(pa.Table.from_batches(waiting), first)
                    yield out
                    waiting, rows = [], 0
        if rows:
            out, first = packed(pa.Table.from_batches(waiting), first)
            yield out

    tasks = max(1, -(-written.rows // TASK_PIECES))
    # Dealt in turn, not by a key: as even as can be, whatever keys there are.
    return written.df.repartition(tasks).sortWithinPartitions(*names).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Tokenize, cut and pack whole documents; every token of a document bears loss."""
    return pack(document_pieces(docs, tokenizer, end_id, limits), limits)
