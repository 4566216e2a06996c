"""Quality rules: text statistics as Spark expressions, and decision lists learned from labelled rows.

A decision list is ordered rules, each a conjunction of thresholds on statistics; the first rule that holds decides,
and where none holds the document is kept. Sequential covering learns it: a rule grows by the threshold that gains
most precision on held-in rows, is pruned on held-out rows, and the rows that it covers leave before the next one.
The list is emitted as a Spark conditional expression, so applying it is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import columns, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled rows that a list is learned from, at most: those with the least hash of their doc_id.
MAX_LABELLED = 6000

FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "short_line_share", "distinct_share")


def _count_of(text: Column, keep: str) -> Column:
    """Characters of ``text`` that the class ``keep`` holds."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def _windows() -> Column:
    """(hash, first word) of every window of WINDOW words, in the order of the hash."""
    windows = F.size("w") - (WINDOW - 1)
    key = lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW)))
    return F.when(windows >= 2, F.sort_array(F.transform(F.sequence(F.lit(0), windows - 1), lambda i: F.struct(key(i).alias("k"), i.alias("i")))))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the features), a row a document.

    All are whole-text counts, made by built-in functions without a shuffle. A null or empty text has no words and
    zeros throughout; shares of nothing are 0; repeated rows and null ids are kept as they are.
    """
    own = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    own = own.select("doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    own = own.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    own = own.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
        _count_of(F.col("text"), r"\p{Lu}").alias("n_upper"),
        _count_of(F.col("text"), r"!?|;:=_\\{}\[\]").alias("n_marks"),
        F.size(F.filter("lines", lambda x: F.length(x) < 20)).cast("long").alias("n_short_lines"),
        _windows().alias("pairs"),
    )
    own = own.withColumn(
        "at",
        F.sort_array(
            F.transform(
                F.filter("pairs", lambda p, i: (p["k"] == F.get("pairs", i - 1)["k"]) | (p["k"] == F.get("pairs", i + 1)["k"])),
                lambda p: p["i"],
            )
        ),
    )
    steps = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW))))
    own = own.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    found = own.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_marks", "word_chars").alias("mark_share"),
        share("n_short_lines", "n_lines").alias("short_line_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )
    # A generator holds back filters: pushed below, they would evaluate the arrays above once more for every element.
    return found.select(F.explode(F.array(F.struct(*found.columns))).alias("s")).select("s.*")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules that reject; a document that none covers is kept."""

    rules: tuple[Rule, ...] = ()

    def kept(self) -> Column:
        """The list as one conditional expression over the columns of ``statistics``."""
        out = None
        for rule in self.rules:
            test = reduce(lambda a, b: a & b, (c.column() for c in rule))
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def keeps(self, row: dict[str, float]) -> bool:
        return not any(all(c.holds(row) for c in rule) for rule in self.rules)

    def __str__(self) -> str:
        says = lambda c: f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}"
        return "\n".join(["if " + " and ".join(map(says, r)) + " then reject" for r in self.rules] + ["else keep"])


def _split_points(rows: list[dict], feature: str, bins: int) -> list[float]:
    """Thresholds midway between neighbouring quantiles of the values."""
    values = sorted(r[feature] for r in rows)
    picked = sorted({values[(len(values) - 1) * k // bins] for k in range(bins + 1)})
    return [(a + b) / 2 for a, b in zip(picked, picked[1:])]


def _precision(bad: int, good: int) -> float:
    return (bad + 1) / (bad + good + 2)


def learn(
    rows: list[dict], features: tuple[str, ...] = FEATURES, max_rules: int = 8, max_conditions: int = 3, bins: int = 24, least_bad: int = 5, precision: float = 0.97
) -> DecisionList:
    """A decision list from rows with the features, doc_id and ``bad`` (0 or 1).

    Every third row (in the order of doc_id) is held out for pruning. A rule stays only if it covers ``least_bad`` bad
    rows with ``precision`` on held-in rows and no less precisely than the rest of them on held-out rows. No rows, or
    rows of one kind only, give the empty list, which keeps all.
    """
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    rules: list[Rule] = []
    count = lambda own: (sum(r["bad"] for r in own), sum(1 - r["bad"] for r in own))
    while len(rules) < max_rules and count(grow)[0] >= least_bad and count(grow)[1]:
        rule: list[Condition] = []
        own = grow
        while len(rule) < max_conditions and count(own)[1]:
            all_bad, all_good = count(own)
            best, best_gain = None, 0.0
            start = _precision(all_bad, all_good)
            for f in features:
                order = sorted(own, key=lambda r: r[f])
                marks = _split_points(own, f, bins)
                at = bad = 0
                for t in marks:
                    while at < len(order) and order[at][f] <= t:
                        bad += order[at]["bad"]
                        at += 1
                    for above, b, n in ((False, bad, at), (True, all_bad - bad, len(order) - at)):
                        if b >= least_bad and (gain := b * (_precision(b, n - b) - start)) > best_gain:
                            best, best_gain = Condition(f, above, t), gain
            if best is None:
                break
            rule.append(best)
            own = [r for r in own if best.holds(r)]
        worth = lambda c: _precision(*count([r for r in prune if all(x.holds(r) for x in c)]))
        while len(rule) > 1 and worth(rule[:-1]) > worth(rule):
            rule.pop()
        covered = [r for r in grow if all(c.holds(r) for c in rule)]
        bad, good = count(covered)
        held_bad, held_good = count([r for r in prune if all(c.holds(r) for c in rule)])
        if not rule or bad < least_bad or bad < precision * (bad + good) or held_bad < precision * (held_bad + held_good):
            break
        rules.append(tuple(rule))
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """The list learned from at most ``max_labelled`` labelled documents (``labels``: doc_id, quality 0 or 1).

    Labels that are null or contradict each other are left out. Documents that fail the base rules teach nothing, as
    those rules decide them.
    """
    wanted = columns(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality in (0, 1)")
    wanted = wanted.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", (1 - F.col("q")).cast("int").alias("bad"))
    own = columns(docs, doc_id=id_col, text=text_col).join(F.broadcast(wanted), "doc_id", "left_semi")
    stats = statistics(own).where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    one = stats.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min(F.struct("bad", *FEATURES)).alias("r"))  # of rows that share an id, the least
    return learn([r.asDict() for r in one.select("doc_id", "r.*").collect()])


def judged(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``statistics`` with base_failed and kept: false where base_failed, else the list's verdict."""
    stats = statistics(docs, id_col, text_col)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules.kept())


def filtered(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return judged(held, rules).where("kept").select("doc_id.*")
