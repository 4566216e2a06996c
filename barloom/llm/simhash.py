"""Near duplicates by SimHash, found by a grid join over segment bit counts.

A fingerprint's 64 bits fall into 32 segments of two bits. The vector of the segments' bit counts (0, 1 or 2 each)
embeds the fingerprint so that the Manhattan distance of two vectors is at most their Hamming distance. Links of up
to three bits therefore have vectors at most three apart, and of the two halves of the vector one is at most one
apart: equal but for a single segment. Every distinct fingerprint is posted in the 32 grid cells that each ignore
one segment of one half; what meets in a cell is verified by its exact Hamming distance. Copies with one fingerprint
are collapsed first, and a cell returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import columns, cut_lineage, small_batches
from barloom.llm.graph import connected_components, joined_apart

SEED = 42
MAX_BITS = 3
#: A cell with more fingerprints is dealt again by blocks of exact bits.
HOT_CELL = 4000
_EVEN = 0x5555555555555555


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a text: XXH64 (seed 42) of its word shingles, a bit set if over half of them set it.

    A-Z are lower-cased; words end at ASCII white space; a text of fewer words is one shingle; no word gives 0.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    parts = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    h = np.array([digest(p, SEED) for p in parts], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row a document; fp is the fingerprint as a signed long. A null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Index pairs that join all of ``fp`` (distinct, unsigned) within ``max_bits``; at most one a fingerprint.

    A search from each fingerprint over those not reached so far: those of a dense group are reached at once.
    """
    found, left = [], np.arange(len(fp))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= max_bits
            if near.any():
                new = left[near].tolist()
                found += [(at, x) for x in new]
                queue += new
                left = left[~near]
    return found


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): each distinct fingerprint in its 32 cells."""
    low, high = f"(fp & {_EVEN}L)", f"(shiftrightunsigned(fp, 1) & {_EVEN}L)"
    counts = F.expr(f"shiftleft({low} & {high}, 1) | ({low} ^ {high})")  # a carry only within a segment, so no sum that overflows
    halves = [F.shiftrightunsigned(F.col("counts"), 32), F.col("counts").bitwiseAND(F.lit(0xFFFFFFFF))]
    keys = [
        F.lit((h * 16 + j) << 32).bitwiseOR(half.bitwiseAND(F.lit(0xFFFFFFFF & ~(3 << (2 * j)))))
        for h, half in enumerate(halves)
        for j in range(16)
    ]
    return fps.select("fp", counts.alias("counts")).select(F.explode(F.array(*keys)).alias("cell"), "fp")


def _linked(cells: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links within the cells, as spanning forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def done(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(cell)) + 1
            start, stop = np.r_[0, cuts], np.r_[cuts, len(cell)]
            a, b = [], []
            for s, e in zip(start[stop - start > 1].tolist(), stop[stop - start > 1].tolist()):
                own = fp[s:e]
                if e - s == 2:
                    if (int(own[0]) ^ int(own[1])).__and__(0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits:
                        a.append(own[0])
                        b.append(own[1])
                    continue
                for x, y in forest(own.view(np.uint64), max_bits):
                    a.append(own[x])
                    b.append(own[y])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cell = np.r_[cell, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy()]
            if not len(cell):
                continue
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if whole:
                yield done(cell[:whole], fp[:whole])
                cell, fp = cell[whole:], fp[whole:]
        if len(cell):
            yield done(cell, fp)

    dealt = cells.repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot_cell: int = HOT_CELL) -> DataFrame:
    """(a, b): edges between distinct fingerprints that give the same components as all links of ``max_bits`` <= 3.

    ``fps`` has a column fp. Cells that hold over ``hot_cell`` fingerprints are dealt again by the value of each of
    four 16-bit blocks (of three differing bits, one block at least has none), so that no group of near copies has to
    meet in one task; this is exact too.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid finds links of at most 3 bits")
    cells = _cells(fps.select("fp").distinct())
    hot = cells.groupBy("cell").count().where(F.col("count") > hot_cell).select("cell", F.lit(True).alias("hot"))
    marked = cells.join(hot, "cell", "left")
    blocks = F.array(*(F.xxhash64("cell", F.lit(i), F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)))
    dealt = marked.select(F.explode(F.when(F.col("hot"), blocks).otherwise(F.array("cell"))).alias("cell"), "fp")
    return _linked(dealt, max_bits)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS, hot_cell: int = HOT_CELL
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row a row of ``docs``.

    fingerprint is 16 lowercase hexadecimal digits; component_id is the smallest doc_id that links of at most
    ``max_bits`` bits reach, the document itself included. A null or empty text has fingerprint zero and links like
    any other; repeated rows are kept, each with the same result; a null doc_id stays null and never becomes a
    component_id unless the component has no other; an empty table gives an empty result.
    """
    fp = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    first = fp.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(first, max_bits, hot_cell))
    named = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    label = joined_apart(named, least, "root", "of").select("fp", "component_id")
    return fp.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ------------------------------------------------------------------------------------------ copies with more edits

#: Texts whose sets of five-word shingles share at least 4/5 of their union are near copies.
WIDE_SHINGLE, NUM, DEN = 5, 4, 5
#: Sets that order shingles from rare to common, and how many of them make one common; any order gives the same links.
ORDER_SETS, COMMON = 4000, 8
#: Sets of a part of a cell, about.
PART = 500

_SETS = "doc_id long, own long, n long, fp long, bits binary, text string"


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted distinct XXH3 (64 bits) of the word shingles, words as in ``simhash``; no word gives none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, "<u8")
    digest = xxhash.xxh3_64_intdigest
    parts = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    return np.unique(np.array([digest(p) for p in parts], dtype="<u8"))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of NUM / DEN at least; exact, in whole numbers."""
    if DEN * min(len(x), len(y)) < NUM * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def _majority(x: np.ndarray) -> int:
    """SimHash fingerprint of a set of hashes."""
    if not len(x):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(x), 65536):
        ones += np.unpackbits(x[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view("<u8")[0])


def _parity(x: np.ndarray) -> bytes:
    """The set's bit map, two bits a member and 64 at least: a bit for each residue, set where an odd number of members have it.

    Two maps of one width differ in no more bits than the sets in members; the halves of a map together (exclusive or)
    are the map of half the width.
    """
    width = 1 << max(6, (2 * len(x) - 1).bit_length())
    return np.packbits((np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _shingled(docs: DataFrame, shingle: int, whole: bool) -> DataFrame:
    """(doc_id, own) of each document, own the hash of its set, and with ``whole`` its size, fingerprint, map and text.

    The text takes less room than its hashes, so those are made again where they are needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            cols = [b.column(0), pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64))]
            if whole:
                fp = np.array([_majority(x) for x in sets], np.uint64).view(np.int64)
                cols += [pa.array([len(x) for x in sets], pa.int64()), pa.array(fp), pa.array([_parity(x) for x in sets], pa.binary()), b.column(1)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "own", "n", "fp", "bits", "text"][: len(cols)])

    return docs.mapInArrow(run, _SETS if whole else "doc_id long, own long")


class _Common:
    """What a bounded part of the sets tells of common shingles: how many sets have one, and one of these sets."""

    def __init__(self, sets: DataFrame, shingle: int) -> None:
        total = sets.count()
        self.every = max(1, total // ORDER_SETS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for o, t in zip(b.column(0).to_pylist(), b.column(1)):
                    token = shingle_set(t.as_py(), shingle).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), o, np.int64))], ["token", "own"])

        some = sets.where(F.pmod(F.xxhash64("own"), F.lit(self.every)) == 0).select("own", "text").mapInArrow(run, "token long, own long")
        found = some.groupBy("token").agg(F.count("*").alias("n"), F.min("own").alias("own")).where(F.col("n") >= COMMON).collect()
        token, count, anchor = (np.array([r[i] for r in found], np.int64) for i in range(3))
        at = np.argsort(token.view(np.uint64))
        self.token, self.count, self.anchor = token.view(np.uint64)[at], count[at], anchor[at]

    def places(self, x: np.ndarray) -> np.ndarray:
        """Places of the members in the list of common ones, -1 for the others."""
        if not len(self.token):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(self.token, x), len(self.token) - 1)
        return np.where(self.token[at] == x, at, -1)

    def posted(self, x: np.ndarray, own: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, part, number of parts) of the rarest shingles of a set, one more than a near copy can lack, so that near copies share one.

        The cell of a common shingle has several parts, and a set goes to one of them; the anchor of the cell goes to all.
        """
        at = self.places(x)
        by = np.argsort(np.where(at >= 0, self.count[at] if len(self.count) else 0, 0), kind="stable")
        by = by[: len(x) - -(-NUM * len(x) // DEN) + 1]
        x, at = x[by].view(np.int64), at[by]
        parts = np.ones(len(x), np.int64)
        if (common := at >= 0).any():
            wanted = np.maximum(1, self.count[at[common]] * self.every // size)
            parts[common] = 1 << np.ceil(np.log2(wanted)).astype(np.int64)
        part = np.full(len(x), own % 0x7FFFFFFF) % parts
        if (hub := common & (parts > 1) & (self.anchor[at] == own if len(self.anchor) else False)).any():
            more = [(c, p, n) for c, n in zip(x[hub].tolist(), parts[hub].tolist()) for p in range(n)]
            x, part, parts = (np.r_[a[~hub], np.array(v, np.int64)] for a, v in zip((x, part, parts), zip(*more)))
        return x, part, parts


def _prefixes(sets: DataFrame, shingle: int, size: int) -> DataFrame:
    """(cell, part, parts, own): each set under its rarest shingles."""
    common = _Common(sets, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for o, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = common.posted(shingle_set(t.as_py(), shingle), o, size)
                rows.append((*found, np.full(len(found[0]), o, np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["cell", "part", "parts", "own"])

    return sets.where("n > 0").select("own", "text").mapInArrow(run, "cell long, part long, parts long, own long")


def _whole_cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Rows sorted by their first ``keys`` columns in batches that end where a cell ends, with the cells of two rows and more."""

    def changes(rows: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(max(0, rows.num_rows - 1), bool)
        for k in range(keys):
            x = rows.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        return np.flatnonzero(new) + 1

    def cut(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, list[tuple[int, int]]]:
        cuts = changes(rows)
        start, stop = np.r_[0, cuts], np.r_[cuts, rows.num_rows]
        more = stop - start > 1
        return rows, list(zip(start[more].tolist(), stop[more].tolist()))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            yield cut(pa.concat_batches(held))
            held = []
        cuts = changes(batch)
        if len(cuts):
            yield cut(pa.concat_batches([*held, batch.slice(0, int(cuts[-1]))]))
            held = []
            batch = batch.slice(int(cuts[-1]))
        held.append(batch)
    if held:
        yield cut(pa.concat_batches(held))


def _groups(prefixes: DataFrame) -> DataFrame:
    """(cell, part, parts, members): the sets of each part of a cell; whole cells of the same sets, as two near copies have many, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cells in _whole_cells(batches, 2):
            cell, part, parts, own = (rows.column(k).to_numpy() for k in range(4))
            found = {}
            for s, e in cells:
                members = own[s:e]
                members = members[np.r_[True, members[1:] != members[:-1]]]
                if len(members) > 1:
                    key = members.tobytes() if parts[s] == 1 else b"%d %d" % (cell[s], part[s])
                    found[xxhash.xxh3_64_intdigest(key)] = (cell[s], part[s], parts[s], members)
            kinds = [*[pa.int64()] * 4, pa.list_(pa.int64())]
            cols = zip(*((np.uint64(k).astype(np.int64), *v) for k, v in found.items())) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["same", "cell", "part", "parts", "members"])

    dealt = prefixes.repartition("cell", "part").sortWithinPartitions("cell", "part", "own")
    found = dealt.mapInArrow(run, "same long, cell long, part long, parts long, members array<long>")
    return found.dropDuplicates(["same"]).drop("same")


class _Maps:
    """Bit maps of the sets of a cell, by width."""

    def __init__(self, n: np.ndarray, bits: list[bytes]) -> None:
        self.n = n
        self.width = np.array([len(b) for b in bits])
        self.row = np.zeros(len(n), np.int64)
        self.table: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.table[w] = np.frombuffer(b"".join([bits[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1)

    def may_link(self, at: int, others: np.ndarray, part: float = 1.0) -> np.ndarray:
        """Which of ``others`` sizes and maps don't rule out: sets of similarity 4/5 differ in a ninth of their sizes at most."""
        size, own = self.n[others], self.n[at]
        near = DEN * np.minimum(size, own) >= NUM * np.maximum(size, own)
        w = int(self.width[at])
        mine = self.table[w][self.row[at]]
        for v in {w // 2, w, w * 2} & self.table.keys():
            which = np.flatnonzero(near & (self.width[others] == v))
            if len(which):
                theirs, same = self.table[v][self.row[others[which]]], mine
                if v > w:
                    theirs = theirs[:, : w // 8] ^ theirs[:, w // 8 :]
                elif v < w:
                    same = mine[: v // 8] ^ mine[v // 8 :]
                apart = np.bitwise_count(theirs ^ same).sum(axis=1, dtype=np.int64)
                near[which] = (DEN + NUM) * apart <= part * (DEN - NUM) * (size[which] + own)
        return near

    def spanning(self, part: float) -> list[tuple[int, int]]:
        """Index pairs that join all that ``may_link`` joins; at most one a set."""
        found, left = [], np.arange(len(self.n))
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = self.may_link(at, left, part)
                if near.any():
                    new = left[near].tolist()
                    found += [(at, x) for x in new]
                    queue += new
                    left = left[~near]
        return found

    def between(self, root: np.ndarray) -> list[tuple[int, int]]:
        """Index pairs of ``may_link`` across different roots."""
        names, which, count = np.unique(root, return_inverse=True, return_counts=True)
        found = []
        if len(names) > 1:
            for at in np.flatnonzero(which != count.argmax()).tolist():
                others = np.flatnonzero((which != which[at]) & ((which == count.argmax()) | (np.arange(len(which)) > at)))
                if len(others):
                    found += [(at, x) for x in others[self.may_link(at, others)].tolist()]
        return found


def _candidates(dealt: DataFrame, first: bool) -> DataFrame:
    """(a, b): within the parts (cell, part, own, n, bits, root), trees of what may link, or all that may link across roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cells in _whole_cells(batches, 2):
            own, n, root = (rows.column(c).to_numpy() for c in (2, 3, 5))
            pairs = set()
            for s, e in cells:
                maps = _Maps(n[s:e], rows.column(4).slice(s, e - s).to_pylist())
                if first:
                    near = maps.spanning(1.0) if e - s == 2 else [p for part in (0.5, 0.8, 1.0) for p in maps.spanning(part)]
                else:
                    near = maps.between(root[s:e])
                pairs.update((own[s + x], own[s + y]) for x, y in near)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = dealt.select("cell", "part", "own", "n", "bits", "root").repartition("cell", "part").sortWithinPartitions("cell", "part")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _trees(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs that join what may link within each part."""
    marks = sets.select("own", "n", "bits", F.lit(0).cast("long").alias("root"))
    return _candidates(groups.select("cell", "part", F.explode("members").alias("own")).join(marks, "own"), True)


def _across(groups: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): all pairs of a cell that may link and have different roots.

    In a cell of several parts, the sets of its most frequent root stay where they are, and the others, which are few
    where the trees have joined what links, go to all parts.
    """
    marks = sets.join(roots, sets.own == roots.node, "left").select("own", "n", "bits", F.coalesce("root", "own").alias("root"))
    kept = ["cell", "part", "own", "n", "bits", "root"]
    rows = lambda which: groups.where(which).select("cell", "part", "parts", F.explode("members").alias("own")).join(marks, "own")
    many = rows("parts > 1")
    most = many.groupBy("cell", "root").count().groupBy("cell").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    many = many.join(most, "cell")
    spread = F.when(F.col("root") == F.col("most"), F.array("part")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    many = many.withColumn("part", F.explode(spread)).dropDuplicates(["cell", "part", "own"])
    return _candidates(rows("parts = 1").select(*kept).union(many.select(*kept)), False)


def _by_fingerprint(sets: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): the links of fingerprints within ``max_bits``, as spanning forests of the grid, and sets of one fingerprint."""
    first = sets.where("n > 0").groupBy("fp").agg(F.min("own").alias("first"))
    same = sets.where("n > 0").select("own", "fp").join(first, "fp").where("own != first").select(F.col("first").alias("a"), F.col("own").alias("b"))
    named = lambda k: first.select(F.col("fp").alias(f"f{k}"), F.col("first").alias(k))
    grid = links(first, max_bits).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    return same.union(grid.join(named("a"), "fa").join(named("b"), "fb").select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs`` whose sets are ``alike``. A text that many pairs have as their a is sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(maxsize=64)(lambda t: shingle_set(t, shingle))
        for b in batches:
            keep = [alike(held(x.as_py()), held(y.as_py())) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = pairs.select(F.explode(F.array("a", "b")).alias("own")).distinct()
    some = cut_lineage(sets.select("own", "text").join(named, "own", "left_semi"))
    side = lambda k: some.select(F.col("own").alias(k), F.col("text").alias(f"of_{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _copies(sets: DataFrame, shingle: int, part: int) -> DataFrame:
    """(node, root): components of all pairs of distinct sets that are ``alike``.

    First the links of fingerprints, and trees of what else may link, are verified, which joins large groups by few
    pairs; then every other pair that may link across the components so found, so that a tree's link that fails hides
    none.
    """
    groups = cut_lineage(_groups(_prefixes(sets, shingle, part)))
    tried = cut_lineage(_by_fingerprint(sets).union(_trees(groups, sets)).distinct())
    edges = cut_lineage(_verified(tried, sets, shingle))
    roots = cut_lineage(connected_components(edges))
    both = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cut_lineage(both(_across(groups, sets, roots)).distinct().join(both(tried), ["a", "b"], "left_anti"))
    more = cut_lineage(_verified(rest, sets, shingle))
    return roots if more.isEmpty() else connected_components(edges.union(more))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, part: int = PART) -> DataFrame:
    """(doc_id, component_id), a row a row of ``docs``: groups joined by texts whose shingle sets have similarity 0.8 and more.

    Links of fingerprints come from the grid, as in ``near_duplicates``, and are verified on the sets. At this
    similarity fingerprints lie further apart than the grid reaches, so the rest is found exactly: each set is posted
    under its rarest shingles, of which near copies share one; sizes and bit maps rule pairs out only where the
    similarity can't be 0.8 (a map's distance bounds that of the sets from below). No pair is missed and none is
    linked unverified. Texts of equal sets are collapsed first; cells of common shingles are divided into parts of
    about ``part`` sets. Null and empty texts are one group; null ids are treated as in ``near_duplicates``.
    """
    small_batches(docs.sparkSession)
    own = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    sets = _shingled(own, shingle, True).groupBy("own").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("n", "fp", "bits", "text")))
    sets = cut_lineage(sets)
    roots = _copies(sets, shingle, part)
    named = sets.join(roots, sets.own == roots.node, "left").select("own", "first", F.coalesce("root", "own").alias("root"))
    least = named.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    label = joined_apart(named, least, "root", "of").select("own", "component_id")
    return _shingled(own, shingle, False).join(label, "own").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component in ``labels`` (``near_copies`` by default).

    Of rows that repeat that id, all stay. Rows with a null id stay only where their component has no other document.
    """
    labels = near_copies(docs, id_col, text_col) if labels is None else labels
    kept = labels.where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("_kept")), "left_semi")
