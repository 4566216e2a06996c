"""Packing of token streams into sequences by order-preserving dynamic programming.

Documents stay in the order of their input split and are cut into consecutive windows, one a sequence. Cuts are
allowed at the end of a document (free), after a token that ends a sentence, and, where neither is near, at fixed
steps (dearer). The cost of a window is its padding: none for a power of two, else what is missing to a full sequence.
For windows that are padded, cost(j) = penalty(j) + size - j + min(cost(i) + i), a minimum over a sliding range that a
monotone queue keeps, so each cut is looked at a constant number of times. Nothing is shuffled: a split packs its own
rows, piece by piece, and carries what is left of the last window over to the next stretch of its documents.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from barloom.llm.common import columns, small_batches

SIZE = 1024
END = 0
#: Penalties, in tokens of padding, of a cut after a sentence and of any other cut within a document.
SENTENCE, HARD = 2.0, 48.0
#: Windows shorter than this are left unpadded at the end of a split only.
SHORT = 64
#: Tokens packed at a time.
STRETCH = 400_000
TOKENIZER = "byte_bpe_50k"

_ENCODERS: dict[str, tuple[Callable[[str], np.ndarray], np.ndarray]] = {}


def encoder(name: str = TOKENIZER) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """(text -> ids, whether each id ends a sentence) of a byte-level vocabulary; made once a process.

    The ids are those of the vocabulary's own tokenizer file: the same ranks, and its one special token as that.
    """
    if name not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": len(ranks)}
        enc = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        ends = np.zeros(len(ranks) + 1, bool)
        for piece, i in ranks.items():
            ends[i] = piece.rstrip(b"\"')").endswith((b".", b"!", b"?", b"\n"))
        allowed = set(special)

        def encode(text: str) -> np.ndarray:
            return np.asarray(enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), dtype=np.uint32)

        _ENCODERS[name] = encode, ends
    return _ENCODERS[name]


def padding(length: int, size: int = SIZE) -> int:
    """Tokens that fill up a sequence of ``length``: none if that is a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def cut_points(sentence_end: np.ndarray, doc_end: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(places of possible cuts, penalties); the last place is the end. Gaps over size/4 get cuts at that step."""
    n = len(sentence_end)
    at = np.flatnonzero(sentence_end | doc_end) + 1
    at = at if len(at) and at[-1] == n else np.r_[at, n]
    gap = np.diff(np.r_[0, at])
    step = size // 4
    more = [np.arange(e - g + step, e, step) for e, g in zip(at[gap > step].tolist(), gap[gap > step].tolist())]
    at = np.unique(np.concatenate([at, *more])) if more else at
    cost = np.where(doc_end[at - 1], 0.0, np.where(sentence_end[at - 1], SENTENCE, HARD))
    return at, cost


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int = SIZE, short: int = SHORT) -> tuple[list[int], float]:
    """(cuts of least cost, cost): windows end at places of ``at`` (ascending, the last one always), none over ``size``.

    Window lengths that are powers of two from ``short`` on need no padding. Ties go to the longer window.
    """
    powers = [1 << k for k in range(size.bit_length()) if short <= 1 << k <= size]
    cost, back = {0: 0.0}, {0: 0}
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j, p in zip(at.tolist(), penalty.tolist()):
        low = j - size
        while queue and queue[0][1] < low:
            queue.popleft()
        key, i = queue[0]
        best = key + size - j
        for w in powers:
            c = cost.get(j - w)
            if c is not None and (c < best or (c == best and j - w < i)):
                best, i = c, j - w
        cost[j], back[j] = best + p, i
        key = best + p + j
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], int(at[-1])
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1], cost[int(at[-1])]


class Packer:
    """Packs documents as they come; ``add`` and ``finish`` return rows of pieces."""

    def __init__(self, ends: np.ndarray, first_id: int, size: int = SIZE, stretch: int = STRETCH) -> None:
        self.ends, self.next_id, self.size, self.stretch = ends, first_id, size, stretch
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # (doc_id, ids that are left, its tokens before them)
        self.totals: list[int] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.totals.append(len(ids))
        self.held += len(ids)
        return self._pack(False) if self.held >= self.stretch else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.docs else []

    def _pack(self, last: bool) -> list[tuple]:
        ids = np.concatenate([d[1] for d in self.docs])
        stops = np.cumsum([len(d[1]) for d in self.docs])
        doc_end = np.zeros(len(ids), bool)
        doc_end[stops - 1] = True
        cuts, _ = best_cuts(*cut_points(self.ends[ids], doc_end, self.size), self.size)
        if last:
            cuts = self._tail(cuts)
        else:
            cuts.pop()
        rows, k, begin = [], 0, 0
        starts = np.r_[0, stops[:-1]].tolist()
        stops = stops.tolist()
        for cut in cuts:
            at = begin
            while at < cut:
                stop = min(cut, stops[k])
                doc_id, _, before = self.docs[k]
                rows.append((doc_id, before + at - starts[k], stop - at, zlib.crc32(ids[at:stop].astype("<u4").tobytes()), self.totals[k], self.next_id, at - begin))
                at = stop
                k += at == stops[k]
            begin = cut
            self.next_id += 1
        if begin < len(ids):
            doc_id, own, before = self.docs[k]
            used = begin - starts[k]
            self.docs = [(doc_id, own[used:], before + used), *self.docs[k + 1 :]]
        else:
            self.docs = []
        self.totals = self.totals[k:] if self.docs else []
        self.held = len(ids) - begin
        return rows

    def _tail(self, cuts: list[int]) -> list[int]:
        """The last window in powers of two, if that saves padding worth the cuts."""
        start = cuts[-2] if len(cuts) > 1 else 0
        length = cuts[-1] - start
        parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
        if padding(length, self.size) > HARD * (len(parts) - 1):
            cuts = [*cuts[:-1], *(start + np.cumsum(parts)).tolist()]
        return cuts


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, size: int = SIZE, stretch: int = STRETCH
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row a piece.

    A document is the ids of its whole text and one id END. start counts its ids before the piece; pieces of a
    sequence follow each other from offset 0 without gaps, at most ``size`` ids together. sequence_id holds the number
    of the input split in its upper bits, so ids are unique but not consecutive. A null or empty text is one END;
    repeated rows and null ids are documents like any other; an empty table has no pieces.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(tokenizer)
        packer = Packer(ends, TaskContext.get().partitionId() << 36, size, stretch)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        end = np.array([END], np.uint32)
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                if rows := packer.add(d, np.r_[encode(t.as_py() or ""), end]):
                    yield batch(rows)
        if rows := packer.finish():
            yield batch(rows)

    own = columns(docs, d=id_col, text=text_col).selectExpr("cast(d as long) as d", "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return own.mapInArrow(run, schema)
