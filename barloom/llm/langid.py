"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes. A symbol that was seen after a context has the share of
its count; one that wasn't costs an escape (the share of the distinct symbols, as in method C) and is looked up after
the context shortened by its first byte; a context a language never saw is shortened for nothing; below the empty
context all symbols are alike. The trees are trained once and frozen, so the code length of a text is a sum over its
bytes, and it is exact: no context is left out. The trees are sparse. A string of a context and a symbol that any
language saw is kept with its cost in every language; for others the escapes of the context are kept, and the string
without its first byte is looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import columns, small_batches

ORDER = 4
#: Bound of the sample: training documents of a language.
DOCS_PER_LANG = 250
#: Bytes scored at a time.
STEP = 1 << 18

_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def symbols(text: str) -> np.ndarray:
    """Lower-cased bytes of a text; runs of white space are one blank, so layout doesn't count."""
    return np.frombuffer(regex.sub(r"\s+", " ", text.lower()).encode("utf-8", "surrogatepass"), np.uint8)


class Index:
    """Places of distinct numbers, found by hashing with linear probes, many at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.mask = (1 << int(64 - int(self.shift))) - 1
        self.table = np.full(self.mask + 1, -1, np.int32)
        left, step, home = np.arange(len(keys)), 0, self._home(keys)
        while len(left):
            slot = (home[left] + step) & self.mask
            free = np.flatnonzero(self.table[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            self.table[at] = left[free[first]]
            left = np.delete(left, free[first])
            step += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._home(keys)
        found = self.table[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found[open_] = self.table[slot[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


@dataclass(frozen=True)
class Level:
    """Contexts of one size: bits of each known string of a context and a symbol, and of each context's escapes, by language."""

    strings: Index
    bits: np.ndarray
    contexts: Index
    escapes: np.ndarray


@dataclass(frozen=True)
class Model:
    """Frozen trees: ``code`` numbers the bytes, ``width`` is how many numbers there are, ``levels`` by context size."""

    langs: tuple[str, ...]
    code: np.ndarray
    width: int
    levels: tuple[Level, ...]

    def bits(self, text: str) -> np.ndarray:
        """Code length of the text in each language."""
        total = np.zeros(len(self.langs))
        order, w = len(self.levels) - 1, self.width
        data = np.r_[np.zeros(order, np.int64), self.code[symbols(text)]]
        for i in range(0, len(data) - order, STEP):
            part = data[i : i + STEP + order]
            n = len(part) - order
            key = part[:n].copy()
            for k in range(1, order + 1):
                key *= w
                key += part[k : n + k]
            for k in range(order, -1, -1):
                level = self.levels[k]
                at = level.strings(key)
                hit = at >= 0
                total += level.bits[at[hit]].sum(axis=0)
                key = key[~hit]
                if not len(key):
                    break
                above = level.contexts(key // w)
                total += level.escapes[above[above >= 0]].sum(axis=0)
                key %= w**k
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the shortest code, ties to the first name; the score is its share of the probability."""
        if text is None or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        bits = self.bits(text)
        best = int(np.argmin(bits))
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())


def train(samples: list[tuple[str, str]], order: int = ORDER) -> Model:
    """A model from (language, text) pairs; no samples give a model without languages, which predicts ``und``."""
    langs = tuple(sorted({lang for lang, _ in samples}))
    if not langs:
        return Model((), np.zeros(256, np.int64), 1, ())
    texts = [[symbols(t) for lang, t in samples if lang == name] for name in langs]
    seen = np.flatnonzero(sum(np.bincount(t, minlength=256) for own in texts for t in own))
    code = np.zeros(256, np.int64)  # 0 stands for the start of a text and for bytes never seen
    code[seen] = np.arange(1, len(seen) + 1)
    w = len(seen) + 1
    counted: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by language and size of context: strings and how often
    for own in texts:
        strings = [[] for _ in range(order + 1)]
        for t in own:
            data = np.r_[np.zeros(order, np.int64), code[t]]
            n, key = len(data) - order, np.zeros(len(data) - order, np.int64)
            for k in range(order + 1):
                key = key + data[order - k : order - k + n] * w**k
                strings[k].append(key)
        counted.append([np.unique(np.concatenate(s), return_counts=True) for s in strings])
    levels: list[Level] = []
    below_keys, below = np.empty(0, np.int64), np.empty((0, len(langs)))
    for k in range(order + 1):
        keys = np.unique(np.concatenate([own[k][0] for own in counted]))
        if k == 0:
            keys = np.arange(w)
        times = np.zeros((len(keys), len(langs)))
        for lang, own in enumerate(counted):
            times[np.searchsorted(keys, own[k][0]), lang] = own[k][1]
        contexts, of = np.unique(keys // w, return_inverse=True)
        begin = np.searchsorted(of, np.arange(len(contexts)))
        total, kinds = np.add.reduceat(times, begin, axis=0), np.add.reduceat((times > 0).astype(float), begin, axis=0)
        escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        shorter = np.full(times.shape, 1 / w) if k == 0 else below[np.searchsorted(below_keys, keys % w**k)]
        chance = np.where(times > 0, times / np.maximum(total + kinds, 1)[of], escape[of] * shorter)
        levels.append(Level(Index(keys), -np.log2(chance), Index(contexts), -np.log2(escape)))
        below_keys, below = keys, chance
    return Model(langs, code, w, tuple(levels))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """A model of at most ``docs_per_lang`` whole documents of each language (the least hashes of doc_id), none held out.

    One row a doc_id is collected, so the bound holds whatever repeats."""
    known = columns(docs, doc_id=id_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_lang).select("doc_id").distinct()
    texts = columns(docs, doc_id=id_col, lang=lang_col, text=text_col).where("lang is not null and text is not null")
    one = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r"))  # of rows that share an id, the least
    return train(sorted((r.lang, r.text) for r in one.select("r.lang", "r.text").collect()))


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row a row of ``docs``.

    lang_pred is ``und`` with score 0 where the text is null or has no letter. Only the text is an input. A null id is
    not held out; repeated rows get equal results.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(2)]
            langs, scores = zip(*found) if found else ((), ())
            cols = [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    own = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
