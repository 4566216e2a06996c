"""SentencePiece encoding by a max-plus scan over chunks, and decoding.

A text is encoded as a path of pieces. In a byte-pair model a path is the encoding exactly if every two neighbouring
pieces encode to themselves when put together: a merge across a border would be the first one there, and would
happen between those two pieces alone as well. So a path has weight 0 if all its neighbours agree and minus infinity
else; in a unigram model its weight is the sum of the scores. A chunk of a giant text turns the state at its left border (the piece
that holds the character before it) into states at its right border: a matrix over (max, +). Matrices combine
associatively: two by two within blocks of chunks, then those of the blocks; going back down the same way
gives every block and every chunk its states, and each chunk traces its pieces back on its own. Where a blank
starts a word and no piece joins it to what is before, the border has one state, so words are solved once and kept.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import columns, small_batches

MODEL = "piece_bpe_32k.model"
#: Characters of a chunk, and words whose pieces a process keeps.
CHUNK, KEPT_WORDS = 32_768, 400_000
#: Longest words that are solved many at once, and chunks whose matrices one task combines.
MANY, BLOCK = 64, 256
#: Slots of what is known of neighbours.
_SLOT_BITS = 21
_SLOTS = 1 << _SLOT_BITS
BLANK = "▁"
State = tuple[int, int]  # a piece by its start and end
_NONE = -1
_START_ID = (1 << 20) - 1


class Model:
    """Pieces of a model file. ``unigram`` adds up scores; else neighbours must agree."""

    def __init__(self, path: str, unigram: bool | None = None) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.unigram = _model_type(raw) == 1 if unigram is None else unigram
        self.as_is = _as_is(raw)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.piece.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(i != sp.unk_id() for i in self.byte)
        # characters of layout that no piece has stand alone, so lines can be solved apart as well
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.piece))
        self.parts = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else ""))
        self.plain = {i: p.replace(BLANK, " ") for p, i in self.piece.items()} | {self.byte[b]: chr(b) for b in range(128) if self.has_bytes}
        self.longest = max(map(len, self.piece))
        self.lowest = min(self.score.values(), default=0.0) - 10.0
        # a blank after another character never joins what is before it: words can be solved apart
        self.words_apart = not any(BLANK in p.lstrip(BLANK) for p in self.piece)
        self.by_last: dict[str, list[int]] = {}
        for p in self.piece:
            self.by_last.setdefault(p[-1], []).append(len(p))
        self.by_last = {c: sorted(set(n), reverse=True) for c, n in self.by_last.items()}
        self.heads: dict = {}  # the pieces as a tree: character -> [what may follow, id of the piece so far]
        for p, i in self.piece.items():
            node = self.heads
            for c in p:
                step = node.setdefault(c, [{}, None])
                node = step[0]
            step[1] = i
        self.table = _Table(self.piece)
        order = sorted(self.score, key=lambda p: -self.score[p])
        self.rank = {p: i for i, p in enumerate(order) if len(p) > 1}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.agreed_ids: dict[int, bool] = {}
        self.solved: dict[str, bytes] = {}  # ids of words as little-endian 32-bit numbers
        self.older: dict[str, bytes] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merging joins last to get ``piece``; None if merging gives no such piece."""
        if piece not in self.split:
            parts, last = list(piece), None
            while len(parts) > 1:
                found = [(self.rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.rank]
                if not found:
                    break
                at = min(found)[1]
                last = parts[at], parts[at + 1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[piece] = last if len(parts) == 1 else None
        return self.split[piece]

    def _agree(self, a: str, b: str) -> bool:
        """Whether no merge across the border comes before the merges that make up the pieces on either side.

        The latest merge of the two sides is undone again and again; what then meets at the border must not form a
        piece that would have come earlier than the merge undone (to the right of it, or in its place).
        """
        if any(len(p) > 1 and self._last_merge(p) is None for p in (a, b)):
            return False
        rank, limit = self.rank, len(self.score)
        while True:
            joint = rank.get(a + b)
            if joint is not None and joint < limit:
                return False
            left, right = rank.get(a, -1) if len(a) > 1 else -1, rank.get(b, -1) if len(b) > 1 else -1
            if left > right:
                limit, a = left, self.split[a][1]
            elif right < 0:
                return True
            else:
                limit, b = right + 1, self.split[b][0]
            for p in (a, b):
                if len(p) > 1:
                    self._last_merge(p)

    def agree(self, a: str, b: str) -> bool:
        """Whether two neighbouring pieces encode to themselves together; ``a`` is empty at the start of a text."""
        key = (a, b)
        known = self.agreed.get(key)
        if known is None:
            if len(self.agreed) > 2 * KEPT_WORDS:
                self.agreed.clear()
            known = self.agreed[key] = self._agree(a, b) if a else len(b) == 1 or self._last_merge(b) is not None
        return known

    def weight(self, before: str, piece: str) -> float | None:
        """What ``piece`` adds to a path after ``before`` (empty: the start); None if it can't follow."""
        if self.unigram:
            return self.score.get(piece, self.lowest)
        return 0.0 if self.agree(before, piece) else None

    def _ending(self, text: str, j: int, low: int) -> Iterator[int]:
        """Starts, not below ``low``, of the pieces that end at j; a character without a piece is one of its own."""
        single = False
        for n in self.by_last.get(text[j - 1], ()):
            if j - n >= low and text[j - n : j] in self.piece:
                single |= n == 1
                yield j - n
        if not single and j - 1 >= low:
            yield j - 1

    def forward(self, text: str, first: State | None, stop: int) -> dict[int, tuple[float, int]]:
        """For each place up to ``stop`` that a path from ``first`` reaches: (weight, start of the last piece).

        One path a place is enough: neighbours that agree make it unique, and scores don't depend on what came before.
        """
        begin, low = (0, 0) if first is None else (first[1], first[0])
        best: dict[int, tuple[float, int]] = {begin: (0.0, low if first is not None else _NONE)}
        for j in range(begin + 1, stop + 1):
            top: tuple[float, int] | None = None
            for i in self._ending(text, j, begin):
                if (old := best.get(i)) is None:
                    continue
                before = text[old[1] : i] if old[1] != _NONE else ""
                w = self.weight(before, text[i:j])
                if w is not None and (top is None or old[0] + w > top[0]):
                    top = (old[0] + w, i)
                    if not self.unigram:
                        break
            if top is not None:
                best[j] = top
        return best

    def crossing(self, text: str, border: int) -> list[State]:
        """Pieces that hold the character before ``border``: the states there."""
        return [(i, j) for j in range(border, min(len(text), border + self.longest - 1) + 1) for i in self._ending(text, j, 0) if i < border]

    def _words_within(self, text: str, left: int, right: int) -> tuple[int, int] | None:
        """First and last place from ``left`` to before ``right`` where a word starts, so that nothing joins across it."""
        if not self.words_apart or self.unigram:
            return None
        starts = [m.start() + 1 if m.start() or text[0] != BLANK else 0 for m in _START.finditer(text, max(0, left - 1), right)]
        starts = [p for p in starts if left <= p < right]
        return (starts[0], starts[-1]) if starts else None

    def transfer(self, text: str, left: int, right: int) -> dict[State | None, dict[State, float]]:
        """The matrix of the chunk between two borders: weights by state at the left one (None: the start of the text).

        Where words start within the chunk, what comes after the first of them is the same for every state, and what
        the states on the right follow from is the last word alone; the words between need no look at all.
        """
        out: dict[State | None, dict[State, float]] = {}
        ends = self.crossing(text, right) if right < len(text) else [(i, right) for i in self._ending(text, right, 0)]
        firsts = [None] if left == 0 else self.crossing(text, left)

        def row(first: State | None, begin: int) -> dict[State, float]:
            best, own = self.forward(text, first, right), {}
            for i, j in ends:
                if (old := best.get(i)) is not None and i >= begin:
                    w = self.weight(text[old[1] : i] if old[1] != _NONE else "", text[i:j])
                    if w is not None:
                        own[i, j] = old[0] + w
            return own

        if within := self._words_within(text, left, right):
            head, tail = within
            shared = row((tail, tail), tail)
            for first in firsts:
                reaches = first is None and head == 0 or first is not None and first[1] <= head and head in self.forward(text, first, head)
                if first is None and head > 0:
                    reaches = head in self.forward(text, None, head)
                out[first] = shared if reaches else {}
            return out
        for first in firsts:
            if first is not None and first[1] >= right:  # a piece longer than the chunk
                out[first] = {first: 0.0}
            else:
                out[first] = row(first, 0 if first is None else first[1])
        return out

    def trace(self, text: str, first: State | None, last: State) -> list[str]:
        """The pieces after ``first`` up to and with ``last``."""
        if first == last:
            return []
        best = self.forward(text, first, last[0])
        pieces, i = [text[last[0] : last[1]]], last[0]
        stop = 0 if first is None else first[1]
        while i > stop:
            start = best[i][1]
            pieces.append(text[start:i])
            i = start
        return pieces[::-1]

    def traced(self, text: str, first: State | None, last: State) -> tuple[list[int], str, list[int]]:
        """The chunk's pieces after ``first`` up to and with ``last``: ids, the whole words after them, and ids behind these."""
        begin = 0 if first is None else first[1]
        within = self._words_within(text, begin, last[0] + 1) if last[0] >= begin else None
        if within is None:
            return self.ids(self.trace(text, first, last)), "", []
        head, tail = within
        out = []
        if head > begin:
            state = (self.forward(text, first, head)[head][1], head)
            out = self.ids(self.trace(text, first, state))
        return out, text[head:tail], self.ids(self.trace(text, (tail, tail), last))

    def trace_ids(self, text: str, first: State | None, last: State) -> list[int]:
        """Ids of the chunk's pieces after ``first`` up to and with ``last``; whole words within are looked up."""
        head, words, tail = self.traced(text, first, last)
        return head + self.encode_normal(words) + tail

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.piece.get(p)) is not None:
                out.append(i)
            elif self.has_bytes:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.sp.unk_id():
                out.append(self.sp.unk_id())
        return out

    def forget(self) -> None:
        """Drops what was remembered of words, so that an idle process holds the model only."""
        self.agreed.clear()
        self.agreed_ids.clear()
        self.solved, self.older = {}, {}

    def word(self, text: str) -> bytes:
        found = self.solved.get(text)
        if found is None and (found := self.older.get(text)) is not None:
            self.solved[text] = found
        if found is None:
            ids = self._word_by_pairs(text) if not self.unigram and len(text) > 1 else None
            if ids is None:
                (row,) = self.transfer(text, 0, len(text)).values()
                last = max(row, key=lambda s: (row[s], -s[0]))
                ids = self.ids(self.trace(text, None, last))
            found = _packed(ids)
            if len(text) <= 64:
                self.solved[text] = found
        return found

    def _word_by_pairs(self, text: str) -> tuple[int, ...] | None:
        """``forward`` and ``trace`` of a whole word in a byte-pair model; None if a character has no piece."""
        agreed, heads, n = self.agreed_ids, self.heads, len(text)
        start, last = [0] * (n + 1), [_NONE] * (n + 1)  # where the piece that ends at a place starts, and which it is
        last[0] = _START_ID
        for i in range(n):
            before = last[i]
            if before == _NONE:
                continue
            node, j = heads, i
            for c in text[i:]:
                step = node.get(c)
                if step is None:
                    break
                node, own = step
                j += 1
                if own is not None and last[j] == _NONE:
                    ok = agreed.get(before << 20 | own)
                    if ok is None:
                        if len(agreed) > KEPT_WORDS:
                            agreed.clear()
                        a, b = text[start[i] : i], text[i:j]
                        ok = agreed[before << 20 | own] = self._agree(a, b) if a else len(b) == 1 or self._last_merge(b) is not None
                    if ok:
                        last[j], start[j] = own, i
        out, j = [], n
        while j:
            if last[j] == _NONE:
                return None
            out.append(last[j])
            j = start[j]
        return tuple(out[::-1])

    def _agree_ids(self, key: int) -> bool:
        """``agree`` for two pieces by their ids, the first one's shifted by 20 bits."""
        known = self.agreed_ids.get(key)
        if known is None:
            if len(self.agreed_ids) > KEPT_WORDS:
                self.agreed_ids.clear()
            names = self.table.names
            a, b = names[key >> 20] if key >> 20 != _START_ID else "", names[key & _START_ID]
            known = self.agreed_ids[key] = self._agree(a, b) if a else len(b) == 1 or self._last_merge(b) is not None
        return known

    def solve(self, words: list[str]) -> None:
        """Keeps the ids of many words of a byte-pair model, found place by place for all of them at once."""
        if self.unigram or not words:
            return
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array(list(map(len, words)))
        code = self.table.codes(raw)
        begin = np.cumsum(size) - size
        known = np.add.reduceat(code == 0, begin) == 0
        if not known.all():
            words = [w for w, k in zip(words, known.tolist()) if k]
            size, code = size[known], code[np.repeat(known, size)]
            if not len(size):
                return
            begin = np.cumsum(size) - size
        top = int(size.max())
        chars = np.zeros((top, len(size)), np.uint8)
        chars[np.arange(len(code)) - np.repeat(begin, size), np.repeat(np.arange(len(size)), size)] = code
        last = np.full((top + 1, len(size)), _NONE, np.int32)
        start = np.zeros((top + 1, len(size)), np.uint8)
        last[0] = _START_ID
        for i in range(top):
            at = np.flatnonzero((last[i] != _NONE) & (size > i))
            before = last[i, at].astype(np.int64) << 20
            node = np.zeros(len(at), np.int32)
            for j in range(i + 1, min(top, i + self.longest) + 1):
                node = self.table.after[node, chars[j - 1, at]]
                live = node > 0
                if not live.all():
                    at, before, node = at[live], before[live], node[live]
                if not len(at):
                    break
                own = self.table.piece[node]
                ends = np.flatnonzero((own != _NONE) & (last[j, at] == _NONE))
                if len(ends):
                    fine = ends[self.table.agree(before[ends] | own[ends], self._agree_ids)]
                    last[j, at[fine]] = own[fine]
                    start[j, at[fine]] = i
        steps, at, j = [], np.arange(len(size)), size.copy()
        done = last[j, at] != _NONE
        at, j = at[done], j[done]
        while len(at):
            steps.append((at, last[j, at]))
            j = start[j, at].astype(np.int64)
            at, j = at[j > 0], j[j > 0]
        if not steps:
            return
        count = np.bincount(np.concatenate([a for a, _ in steps]), minlength=len(size))
        end = np.cumsum(count)
        ids = np.empty(int(end[-1]), "<u4")
        for k, (a, i) in enumerate(steps):
            ids[end[a] - 1 - k] = i
        packed, stop = ids.tobytes(), (4 * end).tolist()
        for w, a, b in zip(words, [0, *stop], stop):
            if b > a:
                self.solved[w] = packed[a:b]

    def packed_many(self, texts: list[str]) -> list[bytes]:
        """``packed_normal`` of many texts: their words that aren't known yet are solved together."""
        if not self.words_apart:
            return [self.packed_normal(t) for t in texts]
        words = [self.parts.findall(t) for t in texts]
        if len(self.solved) >= KEPT_WORDS:  # words that come again move over from the older half
            self.older, self.solved = self.solved, {}
        missing: set[str] = set()
        for w in words:
            missing.update(filterfalse(self.solved.__contains__, w))
        if missing and self.older:
            back = missing & self.older.keys()
            self.solved.update(zip(back, map(self.older.__getitem__, back)))
            missing -= back
        self.solve([w for w in missing if len(w) <= MANY])
        out = []
        for w in words:
            found = list(map(self.solved.get, w))
            if None in found:
                found = [f if f is not None else self.word(x) if len(x) <= CHUNK else _packed(self.scanned(x)) for x, f in zip(w, found)]
            out.append(b"".join(found))
        return out

    def normal(self, text: str) -> str:
        if self.as_is and text:
            return BLANK + text.replace(" ", BLANK)
        return self.sp.normalize(text) if text else ""

    def packed_normal(self, text: str) -> bytes:
        """Ids of a whole normalized text, which is solved word by word, and long words chunk by chunk."""
        if not text:
            return b""
        if self.words_apart:
            return self.packed_many([text])[0]
        return self.word(text) if len(text) <= CHUNK else _packed(self.scanned(text))

    def encode_normal(self, text: str) -> list[int]:
        return _ids(self.packed_normal(text))

    def scanned(self, text: str, chunk: int = CHUNK) -> list[int]:
        """Ids of a text by chunks: matrices, their scan, and each chunk's trace."""
        borders = [*range(0, len(text), chunk), len(text)]
        states = scan([self.transfer(text, a, b) for a, b in zip(borders, borders[1:])])
        return [i for a, b in zip([None, *states], states) for i in self.trace_ids(text, a, b)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are joined, blanks restored, and the blank that encoding puts first taken away."""
        try:
            return "".join([self.plain[i] for i in ids]).removeprefix(" ")
        except KeyError:
            pass
        out, held = [], bytearray()
        sp = self.sp
        for i in ids:
            if sp.is_byte(i):
                held.append(int(sp.id_to_piece(i)[3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if not sp.is_control(i):
                out.append(" ⁇ " if sp.is_unknown(i) else sp.id_to_piece(i).replace(BLANK, " "))
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).removeprefix(" ")


class _Table:
    """Pieces as a tree in arrays, over their 255 most frequent characters, and what is known of neighbours."""

    def __init__(self, piece: dict[str, int]) -> None:
        often = Counter(c for p in piece for c in p)
        own = {c: k for k, (c, _) in enumerate(often.most_common(255), 1) if ord(c) < 1 << 16}
        self.code = np.zeros(1 << 16, np.uint8)
        for c, k in own.items():
            self.code[ord(c)] = k
        self.names = {i: p for p, i in piece.items()}
        steps: dict[tuple[int, int], int] = {}
        ids = {}
        for p, i in piece.items():
            if all(c in own for c in p):
                node = 0
                for c in p:
                    node = steps.setdefault((node, own[c]), len(steps) + 1)
                ids[node] = i
        self.after = np.zeros((len(steps) + 1, len(own) + 1), np.int32)  # 0: no piece goes on so
        for (node, k), to in steps.items():
            self.after[node, k] = to
        self.piece = np.full(len(steps) + 1, _NONE, np.int32)
        self.piece[list(ids)] = list(ids.values())
        self.key, self.fine = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)

    def codes(self, points: np.ndarray) -> np.ndarray:
        return np.where(points < 1 << 16, self.code[points & 0xFFFF], 0).astype(np.uint8)

    def agree(self, keys: np.ndarray, ask: Callable[[int], bool]) -> np.ndarray:
        """``ask`` for each key, remembered in one slot by a hash of the key."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        fine, new = self.fine[slot], self.key[slot] != keys
        if new.any():
            some, back = np.unique(keys[new], return_inverse=True)
            known = np.fromiter(map(ask, some.tolist()), bool, len(some))
            fine[new] = known[back]
            self.key[slot[new]], self.fine[slot[new]] = keys[new], fine[new]
        return fine


_START = re.compile(f"(?:^|[^{BLANK}])(?={BLANK})")
_MODELS: dict[tuple[str, bool | None], Model] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: (number, value)."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            at += size
            yield tag >> 3, data[at - size : at]


def _part(raw: bytes, number: int) -> dict[int, int | bytes]:
    return dict(_fields(next((v for k, v in _fields(raw) if k == number), b"")))


def _model_type(raw: bytes) -> int:
    """model_type of the trainer's part of a model file: 1 unigram, 2 byte pairs."""
    return _part(raw, 2).get(3, 1)


def _as_is(raw: bytes) -> bool:
    """Whether the normalizer's part asks for nothing but a blank in front, and blanks to be written as such."""
    n = _part(raw, 3)
    return not n.get(2) and n.get(3, 1) == 1 and n.get(4, 1) == 0 and n.get(5, 1) == 1


def model(name: str = MODEL, unigram: bool | None = None) -> Model:
    """A public model by its file name, made once a process."""
    if (name, unigram) not in _MODELS:
        import public_tokenizers

        _MODELS[name, unigram] = Model(public_tokenizers.path(name), unigram)
    return _MODELS[name, unigram]


def combine(a: dict, b: dict) -> dict:
    """The (max, +) product of two transfer matrices."""
    out: dict = {}
    for first, row in a.items():
        own: dict = {}
        for mid, w in row.items():
            for last, v in b.get(mid, {}).items():
                if own.get(last, -np.inf) < w + v:
                    own[last] = w + v
        out[first] = own
    return out


def ladder(matrices: list[dict]) -> list[list[dict]]:
    """The matrices, the products of neighbours two by two, of those again, and so on up to one."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([combine(*now[i : i + 2]) if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)])
    return levels


def descend(levels: list[list[dict]], first: State | None, last: State) -> list[State]:
    """The state at the right border of each matrix on the best path from ``first`` to ``last``, found from the whole down to its parts."""
    ends = [last]
    for level in levels[-2::-1]:
        now, left = [], first
        for i, end in enumerate(ends):
            if 2 * i + 1 < len(level):
                a, b = level[2 * i].get(left, {}), level[2 * i + 1]
                now.append(max((s for s in a if end in b.get(s, {})), key=lambda s: (a[s] + b[s][end], -s[0])))
            now.append(end)
            left = end
        ends = now
    return ends


def scan(matrices: list[dict]) -> list[State]:
    """The state at the right border of each chunk on the best path through all of them."""
    levels = ladder(matrices)
    whole = levels[-1][0][None]
    return descend(levels, None, max(whole, key=lambda s: (whole[s], -s[0])))


def _packed(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_name: str = MODEL, chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip[, ids]), a row a row of ``docs``.

    ids are those of the whole text; ids_crc32 is over them as little-endian 32-bit words; round_trip says whether
    decoding gives the text back. A null or empty text has no ids and comes back as empty. Texts of over ``chunk``
    characters are dealt as chunks: matrices, their products by blocks of ``BLOCK`` chunks, states, and traces; a row's
    own place keeps rows with equal ids apart. An empty table gives an empty result; other columns play no part.
    """
    small_batches(docs.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            packed = m.packed_many([m.normal(t) for t in texts])
            ids = list(map(_ids, packed)) if with_ids else [None] * len(packed)
            same = [m.decode(_ids(p)) == t for p, t in zip(packed, texts)]
            cols = [b.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(map(zlib.crc32, packed), pa.int64()), pa.array(same), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"])
        m.forget()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        names = ["doc_id", "own", "n", "k", "before", "size", "text"]
        for b in batches:
            rows = []
            for d, own, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)):
                text = m.normal(t.as_py())
                borders = [*range(0, len(text), chunk), len(text)]
                for k, (s, e) in enumerate(zip(borders, borders[1:])):
                    low = max(0, s - m.longest)
                    rows.append((d, own, len(borders) - 1, k, low, e - s, text[low : e + m.longest]))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 7, [pa.int64()] * 6 + [pa.string()])], names)

    def bounds(before: int, k: int, size: int) -> tuple[int, int]:
        left = k * chunk - before
        return left, left + size

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for b in batches:
            rows = []
            for d, own, n, k, before, size, text in zip(*(c.to_pylist() for c in b.columns)):
                for a, row in m.transfer(text, *bounds(before, k, size)).items():
                    i, j = (_NONE, _NONE) if a is None else (a[0] + before, a[1] + before)
                    rows += [(d, own, n, k, i, j, x + before, y + before, w) for (x, y), w in row.items()]
            kinds = [pa.int64()] * 8 + [pa.float64()]
            names = ["doc_id", "own", "n", "k", "a", "b", "c", "d", "w"]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 9, kinds)], names)

    def parts_of(rows: pd.DataFrame) -> dict[int, dict]:
        parts: dict[int, dict] = {}
        for k, a, b, c, d, w in rows[["k", "a", "b", "c", "d", "w"]].itertuples(index=False):
            parts.setdefault(k, {}).setdefault(None if a == _NONE else (a, b), {})[c, d] = w
        return dict(sorted(parts.items()))

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The product of a block's matrices."""
        whole = ladder(list(parts_of(rows).values()))[-1][0]
        out = [(key[0], key[1], *(a or (_NONE, _NONE)), *c, w) for a, row in whole.items() for c, w in row.items()]
        return pd.DataFrame(out, columns=["own", "k", "a", "b", "c", "d", "w"])

    def borders(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The states at the borders of the blocks of a text."""
        states = scan(list(parts_of(rows).values()))
        return pd.DataFrame([(key[0], k, *x, *y) for k, (x, y) in enumerate(zip([(_NONE, _NONE), *states], states))], columns=["own", "g", "a", "b", "c", "d"])

    def within(key: tuple, rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        """The states at the borders of the chunks of a block, whose own are known."""
        parts = parts_of(rows)
        a, b, c, d = ends[["a", "b", "c", "d"]].iloc[0].tolist()
        states = descend(ladder(list(parts.values())), None if a == _NONE else (a, b), (c, d))
        return pd.DataFrame([(key[0], k, *x, *y) for k, x, y in zip(parts, [(a, b), *states], states)], columns=["own", "k", "a", "b", "c", "d"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for b in batches:
            found = []
            for before, text, i, j, x, y in zip(*(c.to_pylist() for c in b.columns[3:])):
                first = None if i == _NONE else (i - before, j - before)
                found.append(m.traced(text, first, (x - before, y - before)))
            words = m.packed_many([f[1] for f in found])
            ids = [_packed(head) + w + _packed(tail) for (head, _, tail), w in zip(found, words)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], ["doc_id", "own", "k", "ids"])
        m.forget()

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for b in batches:
            rows = []
            for d, t, parts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                packed = b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["k"]))
                ids = _ids(packed)
                rows.append((d, len(ids), zlib.crc32(packed), m.decode(ids) == t.as_py(), ids if with_ids else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
            names = ["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 5, kinds)], names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, ids array<int>"
    own = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    small = own.where(~giant).mapInArrow(whole, schema)
    # equal texts are one here; they are told apart again when the results are joined to the rows
    big = own.where(giant).withColumn("own", F.xxhash64("doc_id", "text"))
    cuts = big.dropDuplicates(["own"]).select("doc_id", "text", "own").mapInArrow(pieces, "doc_id long, own long, n long, k long, before long, size long, text string")
    cuts = cuts.repartition("own", "k")
    steps = cuts.mapInArrow(matrices, "doc_id long, own long, n long, k long, a long, b long, c long, d long, w double")
    blocks = steps.withColumn("g", F.floor(F.col("k") / BLOCK)).groupBy("own", "g")
    state = "a long, b long, c long, d long"
    ends = blocks.applyInPandas(block, f"own long, k long, {state}, w double").groupBy("own").applyInPandas(borders, f"own long, g long, {state}")
    states = blocks.cogroup(ends.groupBy("own", "g")).applyInPandas(within, f"own long, k long, {state}")
    done = cuts.join(states, ["own", "k"]).select("doc_id", "own", "k", "before", "text", "a", "b", "c", "d").mapInArrow(traced, "doc_id long, own long, k long, ids binary")
    done = done.groupBy("own").agg(F.collect_list(F.struct("k", "ids")).alias("parts"))
    large = big.join(done, "own").select("doc_id", "text", "parts").mapInArrow(assembled, schema)
    out = small.union(large)
    return out if with_ids else out.drop("ids")
