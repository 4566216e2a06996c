"""Empty tables, clashing columns, repeated rows, ties and long texts, for every operator and stage."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline as P
from barloom.llm import ann, langid, packing, pii, quality, sentencepiece_scan, sharding, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(60))
MORE = " ".join(f"other{i}" for i in range(60))


def rows():
    return [(1, LONG, "en", "a", 5), (1, LONG, "en", "a", 5), (2, None, None, None, None), (None, "", "en", "b", 0), (3, "x", None, "a", 1), (4, LONG + " " + MORE, "fr", "a", 9)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sharding.sharded(none, sharding.default_shards(5), slots=211).count() == 0
    assert pii.report(pii.find(none, pii.fit(none))).count() == 0
    assert sentencepiece_scan.encoded(none).count() == 0
    assert quality.judged(none, quality.fit(none, labels)).count() == 0
    assert packing.packed(none).count() == 0
    assert langid.predicted(none, langid.fit(none)).count() == 0


def test_stages_of_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in P.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0
        if name != "packing":
            assert out.columns == list(P.COLUMNS)


def test_stages_with_odd_rows_and_no_labels(spark, tmp_path):
    docs = spark.createDataFrame(rows(), DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = P.quality_rules(spark, docs, str(tmp_path))
    assert set(kept.columns) == set(P.COLUMNS)
    once = P.near_dedup(spark, docs, str(tmp_path))
    # of the null and empty texts one row stays, and of the rows that repeat id and text both
    assert sorted((r.doc_id or 0, r.text or "") for r in once.collect()) == sorted([(1, LONG), (1, LONG), (2, ""), (3, "x"), (4, LONG + " " + MORE)])
    cut = {r.doc_id: r.text for r in P.passage_dedup(spark, docs, str(tmp_path)).collect()}
    assert cut[2] is None and cut[None] == "" and len(cut[4]) < len(MORE) + 20
    assert P.personal_data(spark, docs, str(tmp_path)).count() == 6
    packed = P.pack(spark, docs, str(tmp_path)).toPandas()
    assert (packed["length"] > 0).all() and (packed.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_clashing_columns(spark):
    names = "fp cell own a b u v m node root first count e s base cands spans email votes piece ids sequence_id length offset start kept n_words held_out score lang_pred name d x".split()
    docs = spark.createDataFrame(rows(), DOCS).selectExpr("*", *(f"1 as `{n}`" for n in names))
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_copies(docs).count() == 6
    assert set(simhash.keep_one(docs).columns) == set(docs.columns)
    assert set(suffix_dedup.repeated_bytes(docs, whole_rows=True).columns) == set(docs.columns)
    assert set(pii.redacted(docs, pii.fit(docs)).columns) == set(docs.columns)
    assert sentencepiece_scan.encoded(docs).count() == 6
    assert langid.predicted(docs, langid.fit(docs)).count() == 6
    assert packing.packed(docs).count() >= 4
    labels = spark.createDataFrame([(1, 1, 5)], "doc_id long, quality int, n_words int")
    assert set(quality.filtered(docs, quality.fit(docs, labels)).columns) == set(docs.columns)


def test_repeated_rows_get_equal_results(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    for out in (simhash.near_duplicates(docs), suffix_dedup.repeated_bytes(docs), pii.report(pii.find(docs, pii.fit(docs))), sentencepiece_scan.encoded(docs), langid.predicted(docs, langid.fit(docs))):
        own = [tuple(r) for r in out.collect() if r.doc_id == 1]
        assert len(own) == 2 and own[0] == own[1]


def test_many_spans_in_one_text(spark):
    n = 20_000
    text = " ".join(f"a{i}@b.cd" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: [(x.s, x.e) for x in r.email] for r in pii.base_spans(df).collect()}
    assert found == {1: [m.span() for m in re.finditer(r"a[0-9]+@b\.cd", text)], 2: []}
    assert time.time() - began < 60


def test_nearest_is_the_same_for_any_partitioning(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(900, 8)), 1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, [1.0, 2.0]), (5001, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [sorted(map(tuple, ann.nearest(df.repartition(n), df.where("vec_id % 20 = 0"), k=5, least=50, share=0.1).collect())) for n in (1, 37)]
    assert got[0] == got[1] and {r[2] for r in got[0]}.isdisjoint({5000, 5001}) and len(got[0]) == 45 * 5


@pytest.mark.parametrize("least", [40, 10**6])
def test_footrule_ties_go_to_the_smaller_id(least):
    v = np.tile(np.eye(4), (50, 1))
    ids = np.arange(200)[::-1].copy()
    part = ann.Part(ids, v, np.eye(4), 2)
    rows = part.candidates(np.array([0, 1]), 40)
    assert sorted(part.ids[rows].tolist()) == sorted(np.sort(ids[v[:, 0] == 1])[:40].tolist())


def test_shards_take_turns_by_definition():
    """Each shard's whole order of slots is written down first; then they take turns."""
    names, slots = sharding.default_shards(7), 211
    number = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:16], 16)
    orders = {n: [(number(f"offset:{n}") + j * (number(f"skip:{n}") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names}
    assert all(sorted(o) == list(range(slots)) for o in orders.values())
    for weights in ({}, {names[2]: 3}):
        place: dict[int, str] = {}
        while len(place) < slots:
            for n in names:
                for _ in range(weights.get(n, 1)):
                    if len(place) < slots:
                        place[next(s for s in orders[n] if s not in place)] = n
        assert sharding.lookup_table(names, slots, weights) == [place[s] for s in range(slots)]


def test_packing_has_the_ids_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(12)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, _ = packing.encoder()
    pieces = ["the ", "garden", "\n", "\n\n", "  ", "\t", "'s", "'ll", "123", "4567", "é", "中文", "😀", "…", "<|endoftext|>", "<|", "|>", "x" * 40, "a.b@c.de", "\u00a0", "\u200b", "ﬁ", "\r\n", "№", "I'M"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
