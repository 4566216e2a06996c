"""Sharding, HTML, nearest neighbours, SentencePiece, packing, language."""

import random
import zlib

import numpy as np
import pytest

from barloom.llm import ann, html, langid, packing, sentencepiece_scan, sharding

DOCS = "doc_id long, text string"


def test_lookup_table():
    names = sharding.default_shards(7)
    table = sharding.lookup_table(names, 1009)
    sizes = [table.count(n) for n in names]
    assert len(table) == 1009 and max(sizes) - min(sizes) <= 1
    assert table == sharding.lookup_table(names[::-1], 1009)
    less = sharding.lookup_table(names[1:], 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != names[0])
    assert moved < 0.2 * 1009
    heavy = sharding.lookup_table(names, 1009, {names[0]: 3})
    assert abs(heavy.count(names[0]) / 1009 - 3 / 9) < 0.02
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_sharded_rows(spark):
    df = spark.createDataFrame([(i, "x") for i in range(500)] + [(None, "y"), (3, "z")], "doc_id long, slot string")
    out = sharding.sharded(df, sharding.default_shards(5), slots=211).collect()
    table = sharding.lookup_table(sharding.default_shards(5), 211)
    assert len(out) == 502 and all(r.shard == table[r.slot] for r in out)
    assert len({r.shard for r in out if r.doc_id == 3}) == 1 and next(r.slot for r in out if r.doc_id is None) == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">Cookies, yes, no, maybe.</div>
<nav class="menu"><a href=x>Home</a></nav><div class="wrap"><div class="post-content"><h2>Heading</h2><p>First paragraph, with commas, and &eacute;t&eacute; that is long enough to count.</p>
<ul><li>one<li>two</ul><p>Second   paragraph
 goes <a href=y>on</a> and on, until it ends.</p><div class="ad-box">Buy now</div><form><p>Name</p></form></div><div class="sidebar"><p>Side, side, side, side, side, side text text.</p></div>
<div id="comments"><p>Nice, nice, nice, nice, post, I, agree, with, all, of, that.</p></div></div><footer>foot &copy;</footer><script>var a="<p>x</p>";</script></body></html>"""


def test_main_text():
    want = "Heading\nFirst paragraph, with commas, and été that is long enough to count.\none\ntwo\nSecond paragraph goes on and on, until it ends."
    assert html.main_text(PAGE) == want
    assert html.main_text("<p>plain<p>two <b>x") == "plain\ntwo x"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    for nasty in ("<" * 999, "<a href='" * 999, "<!--" * 99, "<div>" * 5000 + "deep", "</p>" * 99, "<b><p></b>x"):
        html.main_text(nasty)


def test_extracted_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, "v", "<p>a &amp; b")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars, r.text.count("\n")) for r in html.extracted(df).collect())
    assert got[:2] == [(1, len(html.main_text(PAGE)), 4), (2, 0, 0)] and got[2] == (2, 5, 0)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16))
    v[1000:1100] = v[0]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    out = ann.nearest(df, df.where("vec_id % 20 = 0"), k=10).toPandas()
    score = v @ v.T
    hits = 0
    for q, own in out.groupby("query_id"):
        own = own.sort_values("rank")
        others = np.delete(np.arange(1500), q)
        best = others[np.lexsort([others, -score[q, others]])[:10]]
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own["score"], score[q, own["vec_id"]])
        hits += len(set(best) & set(own["vec_id"]))
    assert out["query_id"].nunique() == 75 and hits >= 0.9 * 750
    assert ann.nearest(df.limit(0), df).count() == 0
    few = df.where("vec_id < 5")
    assert ann.nearest(few, few, k=10).count() == 20


def test_sentencepiece_matches_the_library():
    m = sentencepiece_scan.model()
    rng = random.Random(1)
    texts = ["", " ", "a", "hello world", "\n\n x", "日本語 text", "x" * 300, " " * 40]
    texts += ["".join(rng.choice("aabbcdehello theiing  \n\té日,.<>") for _ in range(rng.randint(1, 150))) for _ in range(150)]
    for t in texts:
        want = m.sp.encode(t)
        assert m.encode_normal(m.normal(t)) == want
        assert m.decode(want) == t
        if t:
            for chunk in (7, 40):
                assert m.scanned(m.normal(t), chunk) == want


def test_unigram_scan_is_the_best_path():
    m = sentencepiece_scan.Model(__import__("public_tokenizers").path("piece_bpe_32k.model"), unigram=True)
    rng = random.Random(2)
    for _ in range(60):
        t = "".join(rng.choice("abething") for _ in range(rng.randint(1, 14)))
        best = [0.0] + [-1e18] * len(t)
        for j in range(1, len(t) + 1):
            best[j] = max(best[i] + m.score.get(t[i:j], m.lowest if j - i == 1 else -1e18) for i in range(j))
        for chunk in (3, 5, 50):
            pieces = [m.sp.id_to_piece(i) for i in m.scanned(t, chunk)]
            assert "".join(pieces) == t and sum(m.score[p] for p in pieces) == pytest.approx(best[-1])


def test_encoded_rows(spark):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "x" * 900), (4, "".join(rng.choice("abcdefgh") for _ in range(1500))), (4, "hello world " * 90), (4, "hello world " * 90), (5, "日本語" * 200)]
    sp = sentencepiece_scan.model().sp
    want = sorted((d, len(sp.encode(t or "")), zlib.crc32(np.array(sp.encode(t or ""), "<u4").tobytes())) for d, t in rows)
    df = spark.createDataFrame(rows, DOCS)
    for chunk in (100, 10**6):
        found = sentencepiece_scan.encoded(df, chunk=chunk).collect()
        assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want and all(r.round_trip for r in found)


def test_cuts_are_of_least_cost():
    rng = random.Random(2)
    for _ in range(150):
        n, size = rng.randint(1, 150), rng.choice([8, 16, 32])
        ends = np.array([rng.random() < 0.2 for _ in range(n)])
        docs = np.array([rng.random() < 0.05 for _ in range(n)])
        docs[-1] = True
        at, cost = packing.cut_points(ends, docs, size)
        cuts, total = packing.best_cuts(at, cost, size, 2)
        best = {0: 0.0}
        for j, p in zip(at.tolist(), cost.tolist()):
            pad = lambda w: 0 if w & (w - 1) == 0 and w >= 2 else size - w
            best[j] = p + min(best[i] + pad(j - i) for i in best if 0 < j - i <= size)
        assert total == pytest.approx(best[n]) and cuts[-1] == n and max(np.diff([0, *cuts])) <= size


def test_packed_pieces(spark):
    from tokenizers import Tokenizer

    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(5)
    rows = [(1, ""), (2, None), (3, "a <|endoftext|> b. c"), (4, "word. " * 4000), (5, "x" * 9000), (None, "no id")]
    rows += [(10 + i, " ".join(rng.choice(["alpha.", "beta", "gamma\n", "é"]) for _ in range(rng.randint(1, 900)))) for i in range(40)]
    out = packing.packed(spark.createDataFrame(rows, DOCS).coalesce(1), stretch=3000).toPandas()
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = out[out["doc_id"].isna()] if d is None else out[out["doc_id"] == d]
        at = 0
        for p in own.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    pad = total = 0
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
        length = int(own["length"].sum())
        assert length <= 1024
        pad += packing.padding(length)
        total += length
    assert pad < 0.08 * total


def test_language_model(spark):
    rng = random.Random(6)
    words = {"en": "the and ing tion of that with are".split(), "fr": "le la que eau ou une des pour".split(), "de": "der die und sch ung ein mit nicht".split()}
    rows = []
    for i in range(240):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(rng.randint(5, 40))), None if i % 17 == 0 else lang, lang))
    rows += [(900, None, "en", "und"), (901, "12 34 !!", "en", "und"), (902, "", None, "und"), (None, "the and of", "en", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    model = langid.fit(df)
    assert model.langs == ("de", "en", "fr")
    truth = {r[0]: r[3] for r in rows}
    found = langid.predicted(df, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and (r.lang_pred == truth[r.doc_id] or r.doc_id is None)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert langid.train([]).predict("text") == ("und", 0.0)


def ppm_bits(text, train, order):
    """Code length by the definition, byte by byte, from counts of plain strings."""
    data = bytes(langid.symbols(text))
    known = sorted({b for _, t in train for b in bytes(langid.symbols(t))})
    number = {b: i + 1 for i, b in enumerate(known)}
    width, out = len(known) + 1, []
    for lang in sorted({g for g, _ in train}):
        seen = {}
        for g, t in train:
            if g == lang:
                d = [0] * order + [number[b] for b in bytes(langid.symbols(t))]
                for i in range(order, len(d)):
                    for k in range(order + 1):
                        own = seen.setdefault(tuple(d[i - k : i]), {})
                        own[d[i]] = own.get(d[i], 0) + 1
        d, bits = [0] * order + [number.get(b, 0) for b in data], 0.0
        for i in range(order, len(d)):
            p = 1.0
            for k in range(order, -1, -1):
                own = seen.get(tuple(d[i - k : i]))
                if own is None:
                    continue
                total = sum(own.values()) + len(own)
                if d[i] in own:
                    p *= own[d[i]] / total
                    break
                p *= len(own) / total
            else:
                p /= width
            bits -= np.log2(p)
        out.append(bits)
    return out


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_length_by_definition(order):
    rng = random.Random(order)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    train = [("a", make("abc é", 300)), ("a", make("abd", 50)), ("b", make("cde ü", 200)), ("c", make("aeb", 20))]
    model = langid.train(train, order)
    for text in ("abad", "", "zzz?", make("abcdeéü xq", 400), make("abc", 60)):
        assert model.bits(text) == pytest.approx(ppm_bits(text, train, order))
    assert langid.train([("a", "abab abac"), ("b", "cdcd cdce")]).predict("abab")[0] == "a"


def test_index_finds_what_it_holds():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 5000, 1500))
    asked = rng.integers(0, 6000, 4000)
    at = langid.Index(keys)(asked)
    assert (at[at >= 0].astype(bool) | True).all() and (keys[at[at >= 0]] == asked[at >= 0]).all()
    assert (np.isin(asked, keys) == (at >= 0)).all()


def test_language_sample_is_bounded_by_rows(spark):
    df = spark.createDataFrame([(1, "the and", "en")] * 50 + [(3, "le la", "fr")] * 50, DOCS + ", lang string")
    model = langid.fit(df)
    assert model.langs == ("en", "fr") and model.bits("the").shape == (2,)
    assert langid.predicted(df.limit(0), model).count() == 0


