"""Personal data: fixed patterns, and further spans by weak supervision, in Spark expressions only.

The base kinds (email, ip, card, phone) are patterns with a check; their spans are always returned. Candidates of other
kinds (secret, name, id) get votes from four labelers: the shape (regular expressions), a gazetteer, the words before,
and the spread of characters. Expectation-maximisation over the counts of all vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data; a logistic span classifier is trained on those estimates, with
the length and the share of digits as further inputs, and decides which candidates become spans. What is collected for
the training is one row for each combination of kind, votes and buckets, whose number doesn't depend on the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import columns

BASE = ("email", "ip", "card", "phone")

# The patterns of the base kinds, with starts and possessive quantifiers that keep long runs linear, and what a text must hold for one.
_LOCAL = "A-Za-z0-9._%+-"
_PATTERN = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Candidates of the further kinds, and the words of their labelers.
_CANDIDATE = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,}+",
    "name": r"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.? )?[A-Z][a-z]+ [A-Z][a-z]+(?![A-Za-z])",
    "id": r"(?<![A-Za-z0-9.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9-])",
}
_CANDIDATE_NEEDS = {"secret": r"[A-Za-z0-9_-]{16}", "name": r"[A-Z][a-z]+ [A-Z][a-z]", "id": r"[0-9]{3}-[0-9]|[0-9]\) [0-9]|[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"}
_GIVEN = (
    "Adam Alan Albert Alex Alice Amanda Amy Ana Andrea Andrew Angela Ann Anna Anne Antonio Arthur Barbara Benjamin Bernard Beth Brian Bruce Carl Carla Carlos Carmen Carol Caroline Catherine Charles Charlotte Chris Christian Christine Claire Claude Claudia Daniel David Deborah Diana Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fernando Francis Francisco Frank Franz Gary Georg George Gerald Grace Greg Hans Harold Harry Heinrich Helen Helga Henry Hugo Ian Ingrid Isabel Jack Jacob James Jane Janet Jason Javier Jean Jennifer Jessica Joan John Jonathan Jorge Jose Joseph Juan Judith Julia Julie Karen Karl "
    "Katherine Kevin Klaus Kurt Larry Laura Lena Linda Lisa Lucas Lucia Luis Luke Manuel Marc Margaret Maria Marie Mark Markus Martha Martin Mary Matthew Max Michael Michel Miguel Monica Nancy Nicole Nina Olivia Oscar Otto Pablo Patricia Patrick Paul Paula Pedro Peter Philip Pierre Rachel Ralph Raymond Rebecca Richard Robert Roger Rosa Ruth Samuel Sandra Sara Sarah Scott Sofia Sophie Stefan Stephen Steven Susan Teresa Thomas Tim Victor Walter William Wolfgang"
).replace(" ", "|")
_NOT_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|North|South|East|West|New|License|Public|General"
_BEFORE = {
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[ _-]?key|key|bearer|auth)\W{0,5}$",
    "name": r"(?i)(?:name(?: is)?|contact|signed|dear|born|attn)\W{1,3}$",
    "id": r"(?i)(?:ssn|social security|passport|iban|account|tel|phone|call|fax|id)\W{1,5}$",
}
_KEYS = r"(?i)^(?:sk|pk|rk)[_-](?:live|test|prod)|^gh[pousr]_|^AKIA[0-9A-Z]|^xox[abprs]-|^AIza|^eyJ|^glpat-"
_COUNTRY = "^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE)[0-9]{2}"
LABELERS = ("shape", "gazetteer", "context", "spread")
#: Characters before a candidate that its context labeler sees, and matches that are added up at a time.
CONTEXT, BLOCK = 24, 256
#: How much the belief that labelers vote rather right than wrong weighs, as a share of a kind's candidates.
BELIEF = 0.5


def _found(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<s, e, m>>: the leftmost non-overlapping matches, in code points, end exclusive."""
    kind = "array<struct<s:int,e:int,m:string>>"
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gaps"])
        e = s + F.length(x["hits"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hits"].alias("m")))).alias("out"))

    # long lists go block by block, as each step of an aggregate copies what it has; an array binds what is used twice
    def block(x: Column, at: Column) -> Column:
        return F.aggregate(x, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), add)

    def add_block(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(block(x, F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0)))))

    def spans(both: Column) -> Column:
        n = F.size(both)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: F.slice(both, i * BLOCK + 1, F.lit(BLOCK)))
        done = F.aggregate(blocks, F.array().cast(f"array<struct<at:int,out:{kind}>>"), add_block)
        return F.when(n > 0, F.flatten(F.transform(done, lambda d: d["out"]))).otherwise(F.array().cast(kind))

    zipped = F.transform(F.array(parts), lambda p: F.filter(F.arrays_zip(p["gaps"].alias("gaps"), p["hits"].alias("hits")), lambda x: x["hits"].isNotNull()))
    each = F.transform(zipped, spans)
    return F.when(text.rlike(needs), F.element_at(each, 1)).otherwise(F.array().cast(kind))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    doubled = lambda i, v: F.when(i % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + doubled(i, F.ascii(F.substring(d, i + 1, F.lit(1))) - 48))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _passing(kind: str) -> Column:
    return F.filter(kind, lambda x: _valid(kind, x["m"]))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, email, ip, card, phone): each base kind's spans as array<struct<s, e, m>>. A null text is empty."""
    own = columns(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("doc_id", "text", *(_found(F.col("text"), _PATTERN[k], _NEEDS[k]).alias(k) for k in BASE))
    return own.select("doc_id", "text", *(_passing(k).alias(k) for k in BASE))


def _votes(kind: str, m: Column, before: Column) -> list[Column]:
    """The labelers' votes: 1 personal, -1 not, 0 none."""
    yes_no = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    spread = F.size(F.array_distinct(F.split(m, "")))
    shape = {
        "secret": yes_no(m.rlike(_KEYS) | m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9].*[0-9].*[0-9]")), m.rlike("^[0-9]+$|[A-Za-z]{12}")),
        "name": yes_no(m.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\b"), F.length(m) > 40),
        "id": yes_no(m.rlike("^[0-9(]"), never),
    }
    gazetteer = {
        "secret": yes_no(m.rlike(_KEYS), m.rlike("(?i)example|version|test|sample")),
        "name": yes_no(m.rlike(rf"\b(?:{_GIVEN})\b"), m.rlike(rf"\b(?:{_NOT_NAMES})\b")),
        "id": yes_no(m.rlike(_COUNTRY), m.rlike("^(?:000|123-45|666|\\(000)")),
    }
    return [shape[kind], gazetteer[kind], F.when(before.rlike(_BEFORE[kind]), 1).otherwise(-1), yes_no(spread >= 10, spread <= 4)]


def _with_candidates(spans: DataFrame) -> DataFrame:
    """``spans`` with cands: array<struct<kind, s, e, votes, size, digits>> of candidates that touch no base span."""
    own = spans.select("*", *(_found(F.col("text"), p, _CANDIDATE_NEEDS[k]).alias(f"c_{k}") for k, p in _CANDIDATE.items()))
    own = own.select("*", F.concat(*BASE).alias("base"))

    def described(kind: str) -> Column:
        free = F.filter(f"c_{kind}", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        before = lambda x: F.substring(F.col("text"), F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
        return F.transform(
            free,
            lambda x: F.struct(
                F.lit(kind).alias("kind"),
                x["s"].alias("s"),
                x["e"].alias("e"),
                F.array(*_votes(kind, x["m"], before(x))).alias("votes"),
                F.least(F.floor(F.log2(F.length(x["m"]))), F.lit(8)).cast("int").alias("size"),
                F.floor(4 * F.length(_digits(x["m"])) / F.length(x["m"])).cast("int").alias("digits"),
            ),
        )

    return own.select("doc_id", "text", *BASE, F.concat(*map(described, _CANDIDATE)).alias("cands"))


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier by input; reliability[kind, labeler] = P(vote | personal), P(vote | not)."""

    weights: dict[tuple, float] = field(default_factory=dict)
    reliability: dict[tuple[str, str], tuple[dict[int, float], dict[int, float]]] = field(default_factory=dict)
    threshold: float = 0.9

    def accepts(self, c: Column) -> Column:
        """The classifier as an expression over a candidate; a model without weights accepts nothing."""
        if not self.weights:
            return F.lit(False)
        value = {"bias": F.lit(0), "kind": c["kind"], "size": c["size"], "digits": c["digits"]} | {n: F.concat_ws(" ", c["kind"], c["votes"][i].cast("string")) for i, n in enumerate(LABELERS)}
        terms = [F.when(value[k[0]] == F.lit(k[1]), w).otherwise(0.0) for k, w in sorted(self.weights.items(), key=str)]
        return reduce(lambda a, b: a + b, terms) >= math.log(self.threshold / (1 - self.threshold))


def _inputs(r: dict) -> list[tuple]:
    return [("bias", 0), ("kind", r["kind"]), ("size", r["size"]), ("digits", r["digits"]), *((n, f"{r['kind']} {v}") for n, v in zip(LABELERS, r["votes"]))]


def train(patterns: list[dict], rounds: int = 60, steps: int = 400, threshold: float = 0.9) -> SpanModel:
    """A model from counts ``n`` of (kind, votes, size, digits); no candidates give one that accepts nothing.

    Expectation-maximisation starts from the share of positive votes and keeps a prior and reliabilities for each kind,
    as a labeler that is good at names may be poor at secrets. Estimates lean to labelers that vote rather right than
    wrong (``BELIEF``), as classes that only split the personal ones would fit the counts as well. A labeler is taken to
    do no worse than chance: its votes for and against can't change places.
    """
    if not patterns:
        return SpanModel(threshold=threshold)
    kinds = sorted({r["kind"] for r in patterns})
    p = [(1 + sum(v > 0 for v in r["votes"])) / (2 + sum(v != 0 for v in r["votes"])) for r in patterns]
    tables: dict[tuple[str, str], tuple[dict, dict]] = {}
    for _ in range(rounds):
        prior = {}
        for k in kinds:
            mine = [(q, r) for q, r in zip(p, patterns) if r["kind"] == k]
            belief = 1 + BELIEF * sum(r["n"] for _, r in mine)
            prior[k] = (belief / 2 + sum(q * r["n"] for q, r in mine)) / (belief + sum(r["n"] for _, r in mine))
            for i, name in enumerate(LABELERS):
                yes, no = {1: 0.4 * belief, 0: 0.5 * belief, -1: 0.1 * belief}, {1: 0.1 * belief, 0: 0.5 * belief, -1: 0.4 * belief}
                for q, r in mine:
                    yes[r["votes"][i]] += q * r["n"]
                    no[r["votes"][i]] += (1 - q) * r["n"]
                a, b = sum(yes.values()), sum(no.values())
                yes, no = {v: x / a for v, x in yes.items()}, {v: x / b for v, x in no.items()}
                if yes[1] < no[1]:
                    yes[1] = no[1] = (yes[1] + no[1]) / 2
                if yes[-1] > no[-1]:
                    yes[-1] = no[-1] = (yes[-1] + no[-1]) / 2
                tables[k, name] = yes, no
        new = []
        for r in patterns:
            own = [tables[r["kind"], name] for name in LABELERS]
            odds = math.log(prior[r["kind"]] / (1 - prior[r["kind"]])) + sum(math.log(t[0][v] / t[1][v]) for t, v in zip(own, r["votes"]))
            new.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
        moved = max(abs(a - b) for a, b in zip(p, new))
        p = new
        if moved < 1e-9:
            break
    weights = {x: 0.0 for r in patterns for x in _inputs(r)}
    total = sum(r["n"] for r in patterns)
    for _ in range(steps):
        slope = {x: 1e-4 * w for x, w in weights.items()}
        for q, r in zip(p, patterns):
            own = _inputs(r)
            z = sum(weights[x] for x in own)
            g = (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - q) * r["n"] / total
            for x in own:
                slope[x] += g
        for x, g in slope.items():
            weights[x] -= 2.0 * g
    return SpanModel(weights, tables, threshold)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> SpanModel:
    """The span model of all candidates in ``docs``; the counts of vote patterns are combined before the shuffle."""
    seen = _with_candidates(base_spans(docs, id_col, text_col)).select(F.explode("cands").alias("c")).select("c.kind", "c.votes", "c.size", "c.digits")
    counts = seen.groupBy("kind", "votes", "size", "digits").count().collect()
    rows = [{"kind": r.kind, "votes": list(r.votes), "size": r.size, "digits": r.digits, "n": r["count"]} for r in counts]
    return train(sorted(rows, key=lambda r: (r["kind"], r["votes"], r["size"], r["digits"])), threshold=threshold)


def find(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, email, ip, card, phone, spans): spans is array<struct<kind, s, e>>, base first, then added ones.

    Within a kind spans are in the order of their start, in code points with exclusive ends; kinds may overlap. A null
    or empty text has none. Rows are neither dropped nor merged, whatever their ids.
    """
    own = _with_candidates(base_spans(docs, id_col, text_col))
    plain = lambda k: F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    added = F.transform(F.filter("cands", model.accepts), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return own.select("doc_id", "text", *BASE, F.concat(*map(plain, BASE), added).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts, and spans as kind:start:end, by comma."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans become one, of the first.

    Other columns, null texts and rows without spans are as before.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = find(held, model, "row", "text")
    inside = F.sort_array(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def add(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        new = F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))
        return F.when(x["s"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    clean = F.when(F.size("spans") > 0, F.aggregate(inside, start, add, end)).otherwise(F.col("row")[text_col])
    out = found.withColumnRenamed("doc_id", "row").select("row", clean.alias("clean"))
    return out.select(*(F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
