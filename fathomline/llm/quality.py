"""Quality rules: learned decision lists over text statistics.

Statistics are columns computed inside the row. Sequential covering learns, from
a bounded sample of labelled rows, an ordered list of conjunctions of thresholds
that recognise low quality: each rule is grown literal by literal on one part of
the rows, pruned on the other, and the rows it covers are removed before the
next. The list becomes one Spark conditional expression.

A null or empty text has no words, all counts 0, and fails the base rule. Rows
are judged one by one: repeated rows and null ids keep their rows. Without labels
of both classes no rule is learned, and the base rule alone decides. Extra
columns stay as they are; statistics live under ``__`` names until the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
#: bound of the rows that are fetched to learn from
SAMPLE_ROWS = 20_000
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "words_per_line"]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__n_words``, ``__word_chars``, ``__n_symbols``, ``__n_dup_lines``,
    ``__n_repeat_words`` and the learner's ``__f_*`` columns.

    Arrays are columns of their own, so that lambdas do not compute them again."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__words", split_words(body)).withColumn("__lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(A_WORD)))
    d = d.withColumn("__n_words", F.size("__words").cast("long")).withColumn("__word_chars", F.length(F.array_join("__words", "")).cast("long"))
    d = d.withColumn("__n_lines", F.size("__lines").cast("long")).withColumn("__n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    words = F.col("__words")
    threes = F.when(
        F.col("__n_words") >= 3,
        F.transform(F.sequence(F.lit(0), F.col("__n_words").cast("int") - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("__threes", threes)
    # only texts that hold an equal pair are sorted to find where
    found = F.when(
        F.size(F.array_distinct("__threes")) < F.size("__threes"),
        F.array_sort(F.transform("__threes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = d.withColumn("__sorted", found)
    s = F.col("__sorted")

    def twin(x: Column, j: Column) -> Column:
        before = F.when(j > 0, F.get(s, j - 1)["h"] == x["h"]).otherwise(F.lit(False))
        return before | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))

    d = d.withColumn("__twins", F.filter(s, twin)).withColumn("__at", F.sort_array(F.transform("__twins", lambda x: x["i"])))
    at = F.col("__at")
    new = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
    d = d.withColumn("__new", new).withColumn("__n_repeat_words", F.aggregate("__new", F.lit(0).cast("long"), lambda a, b: a + b))
    d = d.withColumn("__n_symbols", F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"))

    def share(a: Column, b: str) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), F.col(b).cast("double")), F.lit(0.0))

    features = {
        "n_words": F.col("__n_words").cast("double"),
        "mean_word": share(F.col("__word_chars"), "__n_words"),
        "symbol_share": share(F.col("__n_symbols"), "__word_chars"),
        "dup_line_share": share(F.col("__n_dup_lines"), "__n_lines"),
        "repeat_share": share(F.col("__n_repeat_words"), "__n_words"),
        "upper_share": share(F.regexp_count(body, F.lit(r"\p{Lu}")), "__word_chars"),
        "digit_share": share(F.regexp_count(body, F.lit("[0-9]")), "__word_chars"),
        "mark_share": share(F.regexp_count(body, F.lit(r"[!?.,;:]")), "__n_words"),
        "words_per_line": share(F.col("__n_words"), "__n_lines"),
    }
    return d.withColumns({f"__f_{k}": v for k, v in features.items()}).drop("__words", "__lines", "__threes", "__sorted", "__twins", "__at", "__new")


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(f"__f_{self.feature}")
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v < self.threshold


Rule = tuple[Literal, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for lit in rule:
        hit &= lit.holds(x)
    return hit


def _grow(x: np.ndarray, low: np.ndarray, steps: int, most: int) -> Rule:
    """Adds the literal of the largest information gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < most and (inside & ~low).any():
        p0, n0 = (inside & low).sum(), (inside & ~low).sum()
        best, choice = 1e-9, None
        for f, name in enumerate(FEATURES):
            v = x[inside, f]
            y = low[inside]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, steps))):
                above = v >= t
                for side in (True, False):
                    hit = above if side else ~above
                    p = (hit & y).sum()
                    n = (hit & ~y).sum()
                    if p and p + n < p0 + n0:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best:
                            best, choice = gain, Literal(name, side, float(t))
        if choice is None:
            break
        rule += (choice,)
        inside &= choice.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, low: np.ndarray) -> Rule:
    """Drops last literals as long as the worth on held-out rows does not fall."""

    def worth(r: Rule) -> float:
        hit = _covers(r, x)
        p, n = (hit & low).sum(), (hit & ~low).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, low: np.ndarray, most_rules: int = 12, most_literals: int = 4, precision: float = 0.98, least: int = 3, steps: int = 33) -> list[Rule]:
    """Sequential covering: an ordered list of rules for low quality.

    ``x`` holds a column for each of FEATURES. Each third row is held out for
    pruning and for the required ``precision``; a rule that covers fewer than
    ``least`` low rows or misses it is left out. The search ends when every low
    row has been tried, ``most_rules`` are found or twice as many were grown."""
    rules: list[Rule] = []
    held = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    open_ = low.copy()  # low rows that no rule, taken or refused, was grown for
    for _ in range(2 * most_rules):
        if len(rules) == most_rules or not ((left & ~held & open_).sum() >= least and (left & ~held & ~low).any()):
            break
        grow, test = left & ~held & (open_ | ~low), left & held
        grown = _grow(x[grow], low[grow], steps, most_literals)
        if not grown:
            break
        for rule in (_prune(grown, x[test], low[test]), grown):
            hit = _covers(rule, x) & left
            p, n = (hit & low).sum(), (hit & ~low).sum()
            pt, nt = (hit & test & low).sum(), (hit & test & ~low).sum()
            if p >= least and p >= precision * (p + n) and pt >= precision * (pt + nt):
                rules.append(rule)
                left &= ~hit
                break
        open_ &= ~_covers(grown, x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from at most ``sample_rows`` labelled rows, those of the smallest hashes of their id.

    Rows that the base rule rejects anyway teach nothing and are left out. Only their statistics come to the driver. Ids with several labels count by the lowest."""
    picked = (labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg(F.min("quality").alias("__quality"))
              .orderBy(F.xxhash64(key), key).limit(sample_rows))
    body = docs.select(F.col(key), F.col(text)).join(F.broadcast(picked), key)
    rows = with_statistics(body, text).select(F.col(key), "__quality", *[f"__f_{f}" for f in FEATURES]).orderBy(F.xxhash64(key), key).limit(sample_rows).collect()
    if not rows:
        return []
    table = np.array([[float(v) for v in r[1:]] for r in rows])
    x = table[:, 1:]
    passed = (x[:, FEATURES.index("n_words")] >= 50) & (x[:, FEATURES.index("repeat_share")] <= 0.5)
    return learn(x[passed], table[passed, 0] == 0)


def verdict(rules: list[Rule]) -> Column:
    """The decision list: index of the first rule that holds, null if none."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        hit = rules[i][0].column()
        for lit in rules[i][1:]:
            hit = hit & lit.column()
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """All rows with their statistics, ``__base_failed``, ``__rule`` and ``__kept``."""
    d = with_statistics(docs, text).withColumn("__base_failed", base_failed()).withColumn("__rule", verdict(rules))
    return d.withColumn("__kept", ~F.col("__base_failed") & F.col("__rule").isNull())


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Rows that no rule rejects, with the columns they came with.

    A filter would be pushed below the statistics, which then would be computed
    again inside its lambdas; a generator that yields one row or none is not."""
    once = F.explode(F.when(F.col("__kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return judged(docs, rules, text).select(*[F.col(f"`{c}`") for c in docs.columns], once.alias("__once")).drop("__once")
