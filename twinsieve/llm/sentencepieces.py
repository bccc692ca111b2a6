"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model says (spaces become U+2581, one is put in front). Every symbol starts
as one character; an agenda holds the adjacent pairs whose union is a piece, best score first and
leftmost among equals, and is worked off until no pair is left. What is no piece then is spelt in bytes.

In these vocabularies the space mark only begins pieces. So no merge crosses a place where a mark follows
another character, and the agenda runs over each such segment by itself; a bounded memo keeps the ids of
segments seen before. Every segment put into the memo is also encoded by the sentencepiece library, a
batch of segments at a time, and the two must agree.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame

from .base import by_batch, texts

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Segments a worker remembers; beyond that it starts afresh.
MEMO = 400_000
# Symbols up to which an agenda is a plain list whose least entry is looked for; a heap takes longer to build than that.
SHORT = 48


class Pieces:
    """One model's vocabulary in this worker."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        plain = [
            i for i in range(size)
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))
        ]
        if self.library.encode("a  b") == self.library.encode("a b") or self.library.encode("") or any(
            MARK in names[i].lstrip(MARK) for i in plain
        ):
            raise ValueError("Only BPE models that keep white space and have the mark in front of pieces are supported.")
        self.ids = {names[i]: i for i in plain}
        self.cost = {names[i]: -self.library.get_score(i) for i in plain}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(size) if self.library.is_byte(i)}
        self.unknown = self.library.unk_id()
        self.surface = [n.replace(MARK, " ") for n in names]
        self.silent = {i for i in range(size) if self.library.is_control(i)}
        for i in self.silent:
            self.surface[i] = ""
        self.surface[self.unknown] = " ⁇ "
        self.spelt = {i: b for b, i in self.bytes.items()}
        self.decimal = [str(i) for i in range(size)]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.wrong: set[str] = set()

    def agenda(self, segment: str) -> tuple[int, ...]:
        """Ids of one normalised segment."""
        ids: list[int] = []
        for symbol in self._by_list(segment) if len(segment) <= SHORT else self._by_heap(segment):
            known = self.ids.get(symbol)
            if known is not None:
                ids.append(known)
            elif self.bytes:
                ids += [self.bytes[b] for b in symbol.encode()]
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def _by_list(self, segment: str) -> list[str]:
        """Symbols of a short segment; the agenda has one entry per adjacent pair, in their order."""
        cost, none = self.cost.get, math.inf
        symbols = list(segment)
        agenda = [cost(pair, none) for pair in map(str.__add__, segment, segment[1:])]
        while agenda and (c := min(agenda)) != none:
            i = agenda.index(c)
            symbols[i] = merged = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(merged + symbols[i + 1], none)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + merged, none)
        return symbols

    def _by_heap(self, segment: str) -> Iterator[str]:
        """Symbols of a segment of any length, in time of n log n."""
        cost = self.cost.get
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        heap = [(c, i) for i, pair in enumerate(map(str.__add__, segment, segment[1:])) if (c := cost(pair)) is not None]
        if heap:
            heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                c, i = heappop(heap)
                left, j = symbols[i], after[i]
                if left is None or j >= n:
                    continue
                merged = left + symbols[j]
                if cost(merged) != c:
                    continue  # one of the two has been merged otherwise since
                symbols[i], symbols[j] = merged, None
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (c := cost(merged + symbols[k])) is not None:
                        heappush(heap, (c, i))
                h = before[i]
                if h >= 0 and (c := cost(symbols[h] + merged)) is not None:
                    heappush(heap, (c, h))
        return filter(None, symbols)

    def encode(self, batch: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text, and whether the library agrees."""
        cut = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in batch]
        if len(self.memo) > MEMO:
            self.memo.clear()
        fresh = list(set(chain.from_iterable(cut)).difference(self.memo))
        for segment in fresh:
            self.memo[segment] = self.agenda(segment)
        asked = [s for s in fresh if s != MARK]  # the mark alone is what the library puts in front
        for segment, said in zip(asked, self.library.encode([s[1:].replace(MARK, " ") for s in asked], num_threads=1)):
            if self.memo[segment] != tuple(said):
                self.wrong.add(segment)
        known = self.memo.__getitem__
        agreed = [not self.wrong or self.wrong.isdisjoint(s) for s in cut]
        return [list(chain.from_iterable(map(known, s))) for s in cut], agreed

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: surfaces in order, runs of byte pieces as UTF-8, without the space put in front."""
        if self.spelt.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                if i in self.spelt:
                    run.append(self.spelt[i])
                    continue
                if run:
                    parts.append(_utf8(bytes(run)))
                    run.clear()
                parts.append(self.surface[i])
            text = "".join(parts) + _utf8(bytes(run))
        first = next((i for i in ids if i not in self.silent), self.unknown)
        return text[1:] if first != self.unknown and self.surface[first][:1] == " " else text


def _utf8(run: bytes) -> str:
    """Each byte that is in no valid character becomes one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError as bad:
        return run[: bad.start].decode() + "�" + _utf8(run[bad.start + 1 :])


@functools.lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def _encoded(columns, model):
    ids, agreed = pieces(model).encode(columns["text"].to_pylist())
    return {"doc_id": columns["doc_id"], "ids": ids, "library_agrees": agreed}


def _decoded(columns, model):
    p = pieces(model)
    return {"doc_id": columns["doc_id"], "text": [p.decode(ids or []) for ids in columns["ids"].to_pylist()]}


def _digests(columns, model):
    p = pieces(model)
    batch = columns["text"].to_pylist()
    ids, agreed = p.encode(batch)
    decimal, sha = p.decimal.__getitem__, hashlib.sha256
    return {
        "doc_id": columns["doc_id"],
        "n_tokens": [len(x) for x in ids],
        "ids_sha256": [sha(",".join(map(decimal, x)).encode()).hexdigest() for x in ids],
        "decoded_sha256": [sha(p.decode(x).encode()).hexdigest() for x in ids],
        "library_agrees": agreed,
    }


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, library_agrees) of each document's whole text.

    A null or empty text has no ids. Repeated rows and null doc_ids give one row each. An empty table
    gives an empty one; columns other than doc_id and text are not looked at.
    """
    return by_batch(texts(docs), _encoded, "doc_id bigint, ids array<int>, library_agrees boolean", model)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""
    return by_batch(encoded.select("doc_id", "ids"), _decoded, "doc_id bigint, text string", model)


def round_trip_digests(docs: DataFrame, model: str) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them, in one pass and without moving the ids.

    Rows as in ``encode``.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, library_agrees boolean"
    return by_batch(texts(docs), _digests, schema, model)
