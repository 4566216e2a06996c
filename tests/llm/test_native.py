"""Quality rules and personal data: against plain Python versions, with no Python in their plans."""

import hashlib
import random
import re
from collections import Counter

from barloom.llm import pii, quality

WS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counts(text):
    text = text or ""
    w = re.findall(WS, text)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(WS, x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(covered)


def odd_texts():
    rng = random.Random(4)
    rows = [None, "", " \n\t", "word", "a b c d e f g h a b c d e f g h", "x " * 50, "é" * 30, "l\nl\n\n \nl", "#*$ %&|<> ok", "😀 😀 a b"]
    rows += [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    return rows + ["long " + "w%d " * 1 % 5 * 20000]


def test_statistics(spark):
    rows = list(enumerate(odd_texts()))
    found = quality.statistics(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found}
    assert got == {i: counts(t) for i, t in rows}


def test_decision_list():
    rng = random.Random(1)
    rows = []
    for i in range(900):
        bad = i % 4 == 0
        f = dict.fromkeys(quality.FEATURES, 0.0) | {"symbol_share": rng.uniform(0.2, 0.5) if bad else rng.uniform(0, 0.15), "mean_word": rng.uniform(3, 9)}
        rows.append(f | {"doc_id": i, "bad": int(bad)})
    rules = quality.learn(rows)
    assert 1 <= len(rules.rules) <= 3 and "symbol_share" in str(rules)
    assert sum(rules.keeps(r) == (not r["bad"]) for r in rows) >= 890
    assert quality.learn([]).rules == () and quality.learn([r for r in rows if r["bad"]]).rules == ()


def test_quality_is_native_and_keeps_clean_texts(spark):
    rng = random.Random(7)
    words = "river stone light garden window quiet morning paper table green".split()
    good = [" ".join(f"{rng.choice(words)}{rng.randint(0, 60)}" for _ in range(60)) for _ in range(120)]
    junk = [" ".join(f"{rng.choice(words)}{rng.randint(0, 60)}###" for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 180)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    out = quality.judged(docs, quality.fit(docs, labels))
    assert not re.search("Python|Pandas|Arrow", plan(out))
    assert {r.doc_id for r in out.collect() if r.kept} == set(range(120))
    wide = docs.selectExpr("*", "1 as n_words", "2 as kept")
    assert quality.filtered(wide, quality.fit(docs, labels)).columns == wide.columns
    assert quality.fit(docs.limit(0), labels).rules == ()


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(d)) % 10 == 0


def base(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text or "", re.A):
            n = sum(c.isdigit() for c in m.group())
            ok = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= n <= 19 and luhn(m.group()), "phone": 9 <= n <= 15}[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans(spark):
    rng = random.Random(1)
    texts = [
        None,
        "",
        "a@b.c_x@d.e.f..g@h.i 1.2.3.4.5.6.7.8 é4111 1111-1111 1111 +1 (017) 555-7713 ",
        "😀x@y.z 256.1.1.1 0001.2.3.4 12 34 56 78 90 12 34 4",
        " ".join(map(str, range(2000))),
        "9" * 30000,
        "a" * 40000 + "@",
        "a." * 10000 + "@b.c",
        "-4111111111111111-",
        "1-4111111111111111",
        "@a.b c@d.e@f.g",
    ]
    texts += ["".join(rng.choice("0123456789 -+.@()ab") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    out = pii.report(pii.find(docs, pii.fit(docs)))
    assert not re.search("Python|Pandas|Arrow", plan(out))
    for r in out.collect():
        want = base(texts[r.doc_id])
        n = Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)


def test_weak_supervision_adds_secrets(spark):
    rng = random.Random(3)
    plain = " ".join("abcdefghij"[rng.randint(0, 9)] * 3 for _ in range(40))
    rows = [(i, f'{plain} token = "{rng.getrandbits(160):040x}" {plain}') for i in range(60)] + [(100 + i, f"{plain} version-2-of-{'x' * 12} {plain}") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r.spans for r in pii.report(pii.find(docs, pii.fit(docs))).collect()}
    assert all("secret:" in found[i] for i in range(60)) and not any(found[100 + i] for i in range(60))
    assert pii.train([]).weights == {} and pii.fit(docs.limit(0)).weights == {}


def test_redaction(spark):
    rows = [(1, "to é a@b.cd, +1 (017) 555-7713!", "s"), (2, None, None), (3, "", "t"), (4, "4111111111111111, 5.6.7.8", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r.text for r in pii.redacted(df, pii.SpanModel()).collect()}
    assert got == {1: "to é [EMAIL], [PHONE]!", 2: None, 3: "", 4: "[CARD], [IP]"}
