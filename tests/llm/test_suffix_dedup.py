import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, x string"


def brute(rows, length=100):
    """Removed bytes of each document by looking at every window."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        keep = bytes(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), spans, hashlib.sha256(keep).hexdigest())
    return out


def texts():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdef ") for _ in range(700))
    rows = []
    for i in range(50):
        t = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 700)))
        k = rng.random()
        if k < 0.3:
            a = rng.randint(0, 500)
            t = t[:300] + passage[a : a + rng.randint(90, 200)] + t[300:]
        elif k < 0.5:
            t += passage
        elif k < 0.6:
            t = "ab" * rng.randint(0, 300)
        elif k < 0.7:
            t = "x" * rng.randint(0, 900)
        elif k < 0.8:
            t = t[:150] + "Z" + t[:150] + "Q" + t[:120]
        rows.append((i, t))
    return rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 70))
def test_suffix_order(symbols, need):
    order = S.suffix_order(np.array(symbols, np.int64), need).tolist()
    keys = [symbols[i : i + need] for i in order]
    assert sorted(order) == list(range(len(symbols)))
    assert keys == sorted(keys)


@pytest.mark.parametrize("how", [{}, {"hot": 0}, {"hot": 2, "chunk": 500}])
def test_matches_brute_force(spark, how):
    rows = texts()
    found = S.repeated_bytes(spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA), **how).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "a" * 150, "p"), (None, None, "q"), (2, "b" * 40, None), (2, "b" * 40, None), (3, "", "r"), (4, "é" * 120, "s"), (5, "é" * 120, "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.n_removed) for r in S.repeated_bytes(df).collect())
    assert got == [(-1, 0), (1, 149), (2, 0), (2, 0), (3, 0), (4, 238), (5, 240)]
    whole = S.repeated_bytes(df, whole_rows=True)
    assert whole.columns == df.columns and whole.count() == len(rows)
    assert whole.where("doc_id = 1").first().text == "a" and whole.where("x = 'q'").first().text is None
    assert S.repeated_bytes(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "t", 1, 2)], "doc_id long, text string, d int, blocks int")
    assert S.repeated_bytes(df, whole_rows=True).collect()[0].asDict() == {"doc_id": 1, "text": "t", "d": 1, "blocks": 2}
