"""Removal of byte strings that occur earlier in a corpus, by suffix sorting with a difference cover.

A text is bytes; a *window* is ``length`` consecutive bytes of one document. Every window that also starts earlier
(smaller doc_id, or earlier in the same document) is covered, and all its bytes go. Steps:

1. Content-defined blocks. A text is cut where a hash of the next few bytes says so; the windows that start in a block
   are fixed by the block and the ``length - 1`` bytes after it. Of equal extended blocks only the first occurrence has
   windows to look at; all windows of the others are covered.
2. Minimizers. Two equal windows have the same least hash of the shorter strings within them. A window whose
   minimizer occurs in no other first block, nor elsewhere in its own text, has no equal.
3. Runs of windows that share one repeated minimizer go, with their text, to the partition of that minimizer, so
   all equal windows meet. There a difference cover (positions modulo three) sorts the suffixes: sampled triples are
   sorted and named, names are sorted by recursion, the remaining suffixes are merged, and adjacent suffixes are
   compared by their first ``length`` bytes. The recursion ends at the depth that ``length`` bytes need.
4. Windows of minimizers that very many blocks share aren't gathered by minimizer: each is dealt by a 128-bit hash of
   its own bytes, and only its first occurrence is sought, a minimum combined before the shuffle; all others of a text
   are covered.

No step keeps all occurrences of a string in one task, drops any, or looks at less than the whole text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import columns, cut_lineage, small_batches

LENGTH = 100
#: Bytes hashed for a minimizer, bytes hashed for a cut, and the mean length of a block.
GRAM, CUT, BLOCK = 24, 16, 512
#: A minimizer in more blocks than this has its windows dealt one by one.
HOT = 20_000
#: Bytes of text sorted at a time, and windows that a task holds before it hands them on.
CHUNK, HELD = 60_000, 200_000
_LAST = (1 << 63, 0, 0)

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), dtype="<u8")


# ------------------------------------------------------------------------------------------ suffix sorting


def _sorted_by(*keys: np.ndarray) -> np.ndarray:
    """Order by the keys, the first one first. Small keys as 16-bit words, which numpy sorts by radix."""
    if all(len(k) == 0 or k.max() < 1 << 16 for k in keys):
        keys = tuple(k.astype(np.uint16) for k in keys)
    return np.lexsort(keys[::-1])


def suffix_order(s: np.ndarray, need: int) -> np.ndarray:
    """Starts of the suffixes of ``s`` (positive integers), sorted by their first ``need`` symbols at least."""
    n = len(s)
    pad = np.zeros(n + 5, np.int64)
    pad[:n] = s
    if need <= 1 or n < 3:
        return _sorted_by(*(pad[i : i + n] for i in range(1 if n >= 3 else 3)))
    extra = n % 3 == 1  # a triple of blanks then ends the first half of the sample
    sample = np.r_[np.arange(1, n + extra, 3), np.arange(2, n, 3)]
    triple = pad[sample], pad[sample + 1], pad[sample + 2]
    order = _sorted_by(*triple)
    new = np.zeros(len(order), bool)
    for x in triple:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    kinds = np.cumsum(new) + 1
    if kinds[-1] < len(order):
        names = np.empty(len(order), np.int64)
        names[order] = kinds
        order = suffix_order(names, -(-need // 3) + 1)
    rank = np.zeros(n + 5, np.int64)
    in_order = sample[order]
    rank[in_order] = np.arange(1, len(order) + 1)
    in_order = in_order[in_order < n]
    ranks = len(order) + 2
    zeros = np.arange(0, n, 3)
    zeros = zeros[_sorted_by(pad[zeros], rank[zeros + 1])]
    kind = in_order % 3
    first, second = in_order[kind == 1], in_order[kind == 2]
    before = np.searchsorted(pad[first] * ranks + rank[first + 1], pad[zeros] * ranks + rank[zeros + 1])
    top = int(pad.max()) + 1
    heads = np.r_[pad[second] * top + pad[second + 1], pad[zeros] * top + pad[zeros + 1]]
    if top * top * ranks > 1 << 62:
        heads = np.unique(heads, return_inverse=True)[1].astype(np.int64)
    before += np.searchsorted(heads[: len(second)] * ranks + rank[second + 2], heads[len(second) :] * ranks + rank[zeros + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zeros))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zeros, in_order
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts in suffix order, class of each): windows at ``starts`` of one class have equal bytes."""
    order = suffix_order(text.astype(np.int64) + 1, length)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    # four bytes at a time, as little-endian words at every place
    word = text.astype(np.uint32)
    word[:-1] |= word[1:] << np.uint32(8)
    word[:-2] |= (word[2:] & np.uint32(0xFFFF)) << np.uint32(16)
    same = np.ones(len(order) - 1, bool)
    live = np.arange(len(order) - 1)
    for i in [*range(0, length - 4, 4), length - 4]:
        w = word[order + i]
        ok = w[live] == w[live + 1]
        same[live[~ok]] = False
        live = live[ok]
    return order, np.r_[0, np.cumsum(~same)]


# ------------------------------------------------------------------------------------------ hashes of a text


class Hashes:
    """Hashes of all strings of a fixed size within a text, by prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _MULT)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(int(_MULT), -1, 1 << 64)))], dtype=np.uint64)

    def __call__(self, text: np.ndarray, *sizes: int) -> list[np.ndarray]:
        self._powers(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTES[text] * self.down[: len(text)], out=sums[1:])
        out = []
        for k in sizes:
            n = max(0, len(text) - k + 1)
            h = (sums[k : k + n] - sums[:n]) * self.up[:n]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            out.append(h)
        return out


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def blocks_of(text: np.ndarray, length: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(start of each block, its number of windows, (minimizers of all blocks, their number by block)).

    A text without a window has no block. A minimizer is listed twice or more if its bytes occur again in the text.
    """
    windows = len(text) - length + 1
    if windows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), (np.empty(0, np.int64), np.empty(0, np.int64))
    cut, gram = hashes(text, CUT, GRAM)
    start = np.flatnonzero(cut[1:windows] < np.uint64((1 << 64) // BLOCK)) + 1
    start = np.r_[0, start]
    mini = sliding_least(gram, length - GRAM + 1)
    gram = np.sort(gram)
    again = gram[:-1][gram[1:] == gram[:-1]]
    new = np.r_[True, mini[1:] != mini[:-1]]
    new[start] = True
    runs = np.flatnonzero(new)
    block, own = np.searchsorted(start, runs, side="right") - 1, mini[runs].view(np.int64)
    if len(again):
        times = 1 + np.isin(own.view(np.uint64), again)
        block, own = np.repeat(block, times), np.repeat(own, times)
    return start, np.diff(np.r_[start, windows]), (own, np.bincount(block, minlength=len(start)))


# ------------------------------------------------------------------------------------------ the distributed steps


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _lists(values: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum(_joined(sizes))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_joined(values), pa.int64()))


def _doc_blocks(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            names, ids, tags, begins, counts, minis, sizes = [], [], [], [], [], [], []
            for d, x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = _bytes(t.as_py())
                start, count, (mini, size) = blocks_of(text, length, hashes)
                raw = text.data
                names += [xxhash.xxh3_128_digest(raw[s : s + n + length - 1]) for s, n in zip(start.tolist(), count.tolist())]
                minis.append(mini)
                sizes.append(size)
                ids += [d] * len(start)
                tags += [x] * len(start)
                begins.append(start)
                counts.append(count)
            cols = [pa.array(names, pa.binary()), pa.array(ids, pa.int64()), pa.array(tags, pa.int64())]
            cols.append(pa.array(_joined(begins) << 32 | _joined(counts), pa.int64()))
            yield pa.RecordBatch.from_arrays([*cols, _lists(minis, sizes)], ["name", "d", "x", "block", "minis"])

    return docs.mapInArrow(run, "name binary, d long, x long, block long, minis array<long>")


def _ranges(packed: np.ndarray) -> list[tuple[int, int]]:
    return [(p >> 32, (p >> 32) + (p & 0xFFFFFFFF)) for p in packed.tolist()]


def _numpy(x: pa.ListScalar) -> np.ndarray:
    return np.empty(0, np.int64) if not x.is_valid else x.values.to_numpy(zero_copy_only=False)


def _runs(raw: bytes, blocks: np.ndarray, minis: np.ndarray, length: int, hashes: Hashes) -> Iterator[tuple[int, int, int]]:
    """(minimizer, first window, last window + 1) of the runs in ``blocks`` whose minimizer is one of ``minis``."""
    minis = np.unique(minis)
    mini = sliding_least(hashes(np.frombuffer(raw, np.uint8), GRAM)[0], length - GRAM + 1).view(np.int64)
    for s, e in _ranges(blocks):
        m = mini[s:e]
        cuts = np.r_[0, np.flatnonzero(m[1:] != m[:-1]) + 1]
        own = m[cuts]
        good = minis[np.minimum(np.searchsorted(minis, own), len(minis) - 1)] == own
        yield from zip(own[good].tolist(), (cuts[good] + s).tolist(), (np.r_[cuts[1:], len(m)][good] + s).tolist())


def _run_texts(joined: DataFrame, length: int, rest: list[str]) -> DataFrame:
    """(key, d, x, at, text): the runs of windows to sort; key is their minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            out: list[tuple] = []
            for r in range(b.num_rows):
                d, x, text = (b.column(i)[r].as_py() for i in range(3))
                minis = np.setdiff1d(_numpy(b.column(4)[r]), _numpy(b.column(5)[r]))
                if len(minis):
                    raw = text.encode("utf-8", "surrogatepass")
                    out += ((m, d, x, i, raw[i : j + length - 1]) for m, i, j in _runs(raw, _numpy(b.column(3)[r]), minis, length, hashes))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["key", "d", "x", "at", "text"])

    wanted = joined.select("d", "x", "text", "blocks", "minis", "hot", *rest)  # rest only so that the texts' shuffle is shared
    return wanted.mapInArrow(run, "key long, d long, x long, at long, text binary")


def _single_windows(joined: DataFrame, length: int, rest: list[str]) -> DataFrame:
    """(name, d, x, at): the windows of hot minimizers by the hash of their bytes, of equal ones in a task the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        first: dict[bytes, tuple[int, int, int]] = {}

        def given() -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            cols = [list(first), *zip(*first.values())] if first else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["name", "d", "x", "at"])

        for b in batches:
            for r in range(b.num_rows):
                d, x, text = (b.column(i)[r].as_py() for i in range(3))
                raw = text.encode("utf-8", "surrogatepass")
                for _, i, j in _runs(raw, _numpy(b.column(3)[r]), _numpy(b.column(4)[r]), length, hashes):
                    for p in range(i, j):
                        name, here = xxhash.xxh3_128_digest(raw[p : p + length]), (d, x, p)
                        if here < first.get(name, _LAST):
                            first[name] = here
                if len(first) > HELD:
                    yield given()
                    first.clear()
        yield given()

    return joined.select("d", "x", "text", "blocks", "hot", *rest).mapInArrow(run, "name binary, d long, x long, at long")


def covered_runs(d: np.ndarray, x: np.ndarray, at: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, start, end): byte ranges of the windows of these records that an earlier one equals."""
    sizes = np.array([len(t) for t in texts])
    text = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    record = np.repeat(np.arange(len(texts)), count)
    inner = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
    starts = begin[record] + inner
    order, kind = equal_windows(text, starts, length)
    where = np.empty(len(text), np.int64)
    where[starts] = np.arange(len(starts))
    idx = where[order]
    by = np.lexsort([at[record] + inner, x[record], d[record]])
    p = np.c_[d[record], x[record], at[record] + inner][by]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.r_[0, (p[1:] != p[:-1]).any(axis=1)])
    least = np.minimum.reduceat(rank[idx], np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]))
    late = np.sort(idx[rank[idx] != least[kind]])
    if not len(late):
        return late, late, late
    new = np.r_[True, (late[1:] != late[:-1] + 1) | (record[late[1:]] != record[late[:-1]])]
    head, tail = late[new], late[np.r_[new[1:], True]]
    return record[head], at[record[head]] + inner[head], at[record[tail]] + inner[tail] + length


def _may_repeat_within(text: bytes, length: int) -> bool:
    """Whether two windows of a run can be equal: what all its windows hold must then have a short period."""
    c = len(text) - length
    middle = text[c:length]
    return len(middle) <= c or middle.find(middle[: len(middle) - c], 1) >= 0


def _sorted_runs(runs: DataFrame, length: int, chunk: int) -> DataFrame:
    """(d, x, s, e): covered byte ranges among the runs of each minimizer.

    Of runs with equal bytes the first stands for all; the others are covered whole. Minimizers that are left with
    one run need no sorting, unless that run can repeat itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            least: dict[tuple, tuple] = {}
            for key, d, x, at, text in rows:
                if (old := least.get((key, text))) is None or (d, x, at) < old:
                    least[key, text] = (d, x, at)
            whole = [(d, x, at, at + len(text)) for key, d, x, at, text in rows if (d, x, at) != least[key, text]]
            per = Counter(key for key, _ in least)
            left = [(*v, text) for (key, text), v in least.items() if per[key] > 1 or _may_repeat_within(text, length)]
            cols = [np.array(c, np.int64) for c in zip(*whole)] if whole else [np.empty(0, np.int64)] * 4
            if left:
                d, x, at, texts = zip(*left)
                d, x, at = (np.array(c, np.int64) for c in (d, x, at))
                r, s, e = covered_runs(d, x, at, list(texts), length)
                cols = [np.r_[a, b] for a, b in zip(cols, (d[r], x[r], s, e))]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["d", "x", "s", "e"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= chunk and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done(held)

    return runs.repartition("key").sortWithinPartitions("key").mapInArrow(run, "d long, x long, s long, e long")


def removed_spans(n: int, blocks: list[tuple[int, int]], covers: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of n bytes: what its first blocks' windows don't leave, and ``covers``."""
    ranges, last = [], 0
    for s, e in sorted(blocks):
        if s > last:
            ranges.append((last, s + length - 1))
        last = max(last, e)
    if n - length + 1 > last:
        ranges.append((last, n))
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges + covers):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _finish(joined: DataFrame, length: int, rest: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                raw = _bytes(b.column(2)[r].as_py()).tobytes()
                blocks, covers, hot = (_numpy(b.column(i)[r]) for i in (3, 4, 5))
                covers = _ranges(covers)
                if len(hot):
                    firsts = np.sort(_numpy(b.column(6)[r]))
                    for _, i, j in _runs(raw, blocks, hot, length, hashes):
                        stops = [i - 1, *firsts[np.searchsorted(firsts, i) : np.searchsorted(firsts, j)].tolist(), j]
                        covers += ((p + 1, q - 1 + length) for p, q in zip(stops, stops[1:]) if q > p + 1)
                spans = removed_spans(len(raw), _ranges(blocks), covers, length)
                keep = raw
                if spans:
                    ends = [0, *(e for _, e in spans)]
                    keep = b"".join(raw[e:s] for e, s in zip(ends, [*(s for s, _ in spans), len(raw)]))
                row = (b.column(0)[r].as_py(), len(raw), len(raw) - len(keep), len(spans), hashlib.sha256(keep).hexdigest())
                rows.append((*row, keep.decode("utf-8", "ignore") if rest else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *rest]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[7:]], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    schema += "".join(f", {c} {joined.schema[c].dataType.simpleString()}" for c in rest)
    return joined.select("d", "x", "text", "blocks", "covers", "hot", "firsts", *rest).mapInArrow(run, schema)


_NULL_ID = -(1 << 63)


def _packed(s: str, e: str) -> Column:
    return F.shiftleft(F.col(s), 32).bitwiseOR(F.col(e) - F.col(s))


def repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, chunk: int = CHUNK, whole_rows: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row a row of ``docs``.

    With ``whole_rows`` instead ``docs`` itself, with what remains in ``text_col``, a character cut in two left out, and
    a null text still null.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier. n_spans counts the maximal removed
    runs; kept_sha256 is that of the remaining bytes. A null text counts as empty and loses nothing, as does a text shorter than ``length``. Rows that share a doc_id are
    documents of their own, in the order of a hash of their texts; rows that repeat both id and text are one document
    and get equal results. A null doc_id sorts first. An empty table gives an empty result.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    small_batches(docs.sparkSession)
    own = columns(docs, d=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    keys = [F.coalesce(F.col("d").cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64(text).alias("x"), text.alias("text")]
    rest = ["rest"] if whole_rows else []
    found = _doc_blocks(own.select(*keys), length)
    first = found.groupBy("name").agg(F.min(F.struct("d", "x", "block", "minis")).alias("f"))
    first = first.select(F.xxhash64("name").alias("own"), "f.*")
    listed = first.select(F.explode("minis").alias("mini"), "own")
    often = listed.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1")  # counted before the shuffle, so a common one meets nowhere
    shared = (
        listed.join(often, "mini")
        .groupBy("own")
        .agg(F.collect_set("mini").alias("minis"), F.collect_set(F.when(F.col("n") > hot, F.col("mini"))).alias("hot"))
    )
    by_doc = cut_lineage(
        first.select("own", "d", "x", "block")
        .join(shared, "own", "left")
        .groupBy("d", "x")
        .agg(F.collect_list("block").alias("blocks"), F.flatten(F.collect_list("minis")).alias("minis"), F.flatten(F.collect_list("hot")).alias("hot"))
    )
    if rest:
        others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.col(f"`{text_col}`").isNull().alias("_no_text"))
        own = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("text"), others.alias("rest"))
    texts = own.select(*keys, *rest).repartition("d", "x")
    covers = _sorted_runs(_run_texts(texts.join(by_doc.where(F.size("minis") > 0), ["d", "x"]), length, rest), length, chunk)
    covers = covers.groupBy("d", "x").agg(F.collect_list(_packed("s", "e")).alias("covers"))
    single = _single_windows(texts.join(by_doc.where(F.size("hot") > 0), ["d", "x"]), length, rest)
    firsts = single.groupBy("name").agg(F.min(F.struct("d", "x", "at")).alias("f")).select("f.*")
    firsts = firsts.groupBy("d", "x").agg(F.collect_list("at").alias("firsts"))
    joined = texts.join(by_doc.select("d", "x", "blocks", "hot"), ["d", "x"], "left").join(covers, ["d", "x"], "left").join(firsts, ["d", "x"], "left")
    out = _finish(joined, length, rest)
    if rest:
        text = F.when(~F.col("rest._no_text"), F.col("kept_text"))
        return out.select(*(text.alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))
    return out.select(F.nullif("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
