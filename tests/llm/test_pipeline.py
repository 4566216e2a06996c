"""The pipeline's stages against plain versions of what each has to do."""

import random

import pytest

import __spark_entry__
import corpus_pipeline as P
from barloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "river stone light garden window quiet morning paper table green".split() for b in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(rng.randint(40, 160))) for i in range(80)]
    rows += [(100 + i, " ".join(w + "###" for w in prose(60).split())) for i in range(40)]
    near = prose(400).split()
    for i in range(5):
        own = list(near)
        own[i * 7], own[200 + i] = f"edit{i}", f"more{i}"
        rows.append((200 + i, " ".join(own)))
    rows += [(300 + i, rows[3][1]) for i in range(3)]
    rows += [(400 + i, f"{prose(60)} {passage} {prose(60)}") for i in range(4)]
    rows += [(500, prose(60) + " mail a@b.cd or +1 (017) 555-7713 " + prose(30)), (600, None), (601, ""), (602, "few words")]
    return rows, passage


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows, passage = corpus()
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows], SCHEMA)
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(d, int(not 100 <= d < 200)) for d, _ in rows], "doc_id long, quality int").write.parquet(str(folder / "labels.parquet"))
    out, now = [], spark.read.parquet(str(folder / "documents.parquet"))
    for name, stage in P.STAGES:
        stage(spark, now, str(folder)).write.parquet(str(folder / name))
        now = spark.read.parquet(str(folder / name))
        out.append(now.toPandas())
    return str(folder), rows, passage, out


def test_stages_keep_the_columns(staged):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "passage_dedup", "personal_data", "packing"]
    for pdf in staged[3][:-1]:
        assert list(pdf.columns) == list(P.COLUMNS)


def test_quality_drops_junk_and_keeps_prose(staged):
    kept = set(staged[3][0]["doc_id"])
    assert kept == {d for d, t in staged[1] if not 100 <= d < 200 and len((t or "").split()) >= quality.MIN_WORDS}


def test_one_of_each_group_stays(staged):
    before, after = set(staged[3][0]["doc_id"]), set(staged[3][1]["doc_id"])
    assert before - after == {201, 202, 203, 204, 300, 301, 302}


def test_passages_are_cut_after_their_first_place(staged):
    before = dict(zip(staged[3][1]["doc_id"], staged[3][1]["text"]))
    seen, want = set(), {}
    for d in sorted(before):
        raw = before[d].encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(raw[i : i + 100])
        want[d] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    after = staged[3][2]
    assert dict(zip(after["doc_id"], after["text"])) == want and staged[2] not in want[401]
    assert (after["text"].str.len() == after["n_chars"]).all()


def test_personal_data_is_replaced(staged):
    after = dict(zip(staged[3][3]["doc_id"], staged[3][3]["text"]))
    assert "mail [EMAIL] or [PHONE] " in after[500] and set(after) == set(staged[3][2]["doc_id"])
    same = dict(zip(staged[3][2]["doc_id"], staged[3][2]["text"]))
    assert all(after[d] == same[d] for d in after if d != 500)


def test_run_gives_the_last_stage(spark, staged):
    got = P.run(spark, staged[0]).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == staged[3][4].groupby("doc_id")["length"].sum().to_dict()


def test_entries_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
