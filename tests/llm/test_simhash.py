import random

import numpy as np
import pytest
import xxhash

from barloom.llm import simhash as S
from barloom.llm.graph import connected_components


def components(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").split(" ") if x]
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def sample():
    rng = random.Random(1)
    base = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 40)) for _ in range(400)]
    rows = [(0, ""), (1, None), (2, "One"), (3, "one")]
    for i in range(4, 90):
        w = list(base) if i % 3 else [f"w{rng.randint(0, 999)}" for _ in range(60)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"q{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    return rows


def test_fingerprint_by_definition():
    for _, t in sample():
        assert S.simhash(t) == plain(t)


@pytest.mark.parametrize("hot", [4000, 1])
def test_components_match_brute_force(spark, hot):
    rows = sample()
    fp = {d: S.simhash(t) for d, t in rows}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    assert any(fp[a] != fp[b] for a, b in pairs)
    found = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot_cell=hot).collect()
    assert {r.doc_id: r.component_id for r in found} == components(pairs, fp)
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == fp


def test_all_distances_up_to_three(spark):
    rng = random.Random(3)
    a = rng.getrandbits(64)
    fps = [a] + [a ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4, 5) for _ in range(30)]
    signed = np.array(sorted(set(fps)), np.uint64).view(np.int64).tolist()
    edges = S.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    pairs = [(x, y) for x in signed for y in signed if x < y and ((x ^ y) & (2**64 - 1)).bit_count() <= 3]
    assert components([(e.a, e.b) for e in edges], signed) == components(pairs, signed)
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_near_copies_and_odd_rows(spark):
    rng = random.Random(2)
    base = " ".join(f"w{rng.randint(0, 500)}" for _ in range(300))
    edited = base.split()
    edited[10], edited[200] = "x", "y"
    rows = [(5, base), (7, " ".join(edited)), (9, " ".join(f"z{i}" for i in range(300))), (None, base), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_copies(df).collect()}
    assert got == {5: 5, 7: 5, 9: 9, None: 5, 11: 11, 12: 11}
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == [5, 9, 11]
    assert S.near_copies(df.limit(0)).count() == 0 and S.near_duplicates(df.limit(0)).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def jaccard(x, y):
    x, y = ({" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x, y))
    return len(x & y) / len(x | y)


def test_texts_below_the_similarity_stay(spark):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for k in range(60):
        shared = prose(160)
        rows += [(2 * k + j, " ".join(shared + prose(30 + k % 3 * 8))) for j in range(2)]
    assert all(0.6 < jaccard(rows[2 * k][1], rows[2 * k + 1][1]) < 0.8 for k in range(60))
    got = {r.doc_id: r.component_id for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d for d, _ in rows}


def test_copies_at_the_similarity_match_brute_force(spark):
    rng = random.Random(6)
    prose = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    common, rows = prose(40), []
    for k in range(120):
        base = prose(200) + (common if k % 3 == 0 else [])
        rows.append((10 * k, " ".join(base)))
        for j in range(1, 3):  # about 0.75 to 0.9
            own = list(base)
            for at in rng.sample(range(len(own)), 2 + k % 4):
                own[at] = f"e{rng.randint(0, 10**6)}"
            rows.append((10 * k + j, " ".join(own)))
    sim = {(a, b): jaccard(x, y) for a, x in rows for b, y in rows if a < b and a // 10 == b // 10}
    assert sum(0.8 <= v < 0.85 for v in sim.values()) > 40 and sum(0.7 < v < 0.8 for v in sim.values()) > 40
    got = {r.doc_id: r.component_id for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components([p for p, v in sim.items() if v >= 0.8], [d for d, _ in rows])


def test_maps_rule_no_near_copy_out():
    rng = np.random.default_rng(7)
    sets = [np.sort(rng.choice(2**62, n, replace=False).astype(np.uint64)) for n in (300, 260, 1000, 30)]
    near = [np.sort(np.r_[x[: len(x) - len(x) // 15], rng.choice(2**62, len(x) // 15).astype(np.uint64)]) for x in sets]
    every = sets + near
    maps = S._Maps(np.array([len(x) for x in every]), [S._parity(x) for x in every])
    assert {tuple(sorted(p)) for p in maps.between(np.arange(8))} == {(k, k + 4) for k in range(4)}
    assert maps.between(np.zeros(8, int)) == []
    for a in range(8):
        assert all(maps.may_link(a, np.array([b]))[0] for b in range(8) if S.alike(every[a], every[b]))


def test_maps_of_other_widths():
    rng = np.random.default_rng(8)
    for n in (120, 128, 129, 136, 255, 257):
        x = rng.choice(2**62, n, replace=False).astype(np.uint64)
        for m in (n - n // 12, n):
            y = np.r_[x[: n - n // 12], rng.choice(2**62, m - (n - n // 12)).astype(np.uint64)]
            x1, y1 = np.sort(x), np.sort(y)
            maps = S._Maps(np.array([len(x1), len(y1)]), [S._parity(x1), S._parity(y1)])
            assert S.alike(x1, y1) and maps.may_link(0, np.array([1]))[0] and maps.may_link(1, np.array([0]))[0]


@pytest.mark.parametrize("part", [1, 3, 2000])
def test_divided_cells_lose_no_link(spark, part):
    """Groups of many near copies, whose shingles are common, so that their cells are divided."""
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for k in range(4):
        base = prose(120)
        for j in range(30):
            own = list(base)
            for at in rng.sample(range(len(own)), (0, 1, 2, 3)[k]):
                own[at] = f"e{rng.randint(0, 10**6)}"
            rows.append((100 * k + j, " ".join(own)))
    sim = {(a, b): jaccard(x, y) for a, x in rows for b, y in rows if a < b and a // 100 == b // 100}
    assert sum(0.75 < v < 0.8 for v in sim.values()) > 30 and sum(0.8 <= v < 0.85 for v in sim.values()) > 30
    got = {r.doc_id: r.component_id for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), part=part).collect()}
    assert got == components([p for p, v in sim.items() if v >= 0.8], [d for d, _ in rows])
