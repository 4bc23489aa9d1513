"""Quality rules: text statistics, and a decision list learned from labelled statistics.

All work on documents is DataFrame expressions. Rules are learned on the driver from the statistics
of at most MOST_LABELLED labelled documents, by sequential covering: grow one conjunction of
thresholds on two thirds of the sample, prune it on the rest, keep it if it is precise on both, take
away what it covers, and go on. The list becomes an ordered CASE expression.

Null and empty texts have no words and fail the base rule. Ties and repeated rows do not matter, as
each row is judged alone; a document with several labels counts once, as bad if any label says so.
Without labels no rule is learned and the base rule alone decides. Columns of the input other than
doc_id and text are not read here and survive in ``filtered`` under their own names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common

#: Labelled documents at most whose statistics the rules are learned from, the lowest hashes of doc_id.
MOST_LABELLED = 6000
MIN_PRECISION = 0.97
MIN_COVERED = 5
MOST_RULES = 12
MOST_CONDITIONS = 3

_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def features() -> dict[str, Column]:
    """What rules may test, from a row's statistics. Lengths are left out: long and short clean texts both stay."""
    return {
        "symbols_per_word": F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
        "marks_per_word": F.col("n_marks") / F.greatest(F.col("n_words"), F.lit(1)),
        "upper_share": F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    }


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, is at least, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, least, value in self.conditions:
            out = out & ((F.col(name) >= value) if least else (F.col(name) <= value))
        return out


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """The input's rows with _at, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the other features.

    Five-word windows are compared by a 64-bit hash within one text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    found = docs.withColumns({
        "_words": F.array_remove(F.split(text, "[ \\t-\\r]+"), ""),
        "_lines": lines,
        "word_chars": F.length(F.translate(text, _BLANKS, "")),
        "n_symbols": _without(text, _SYMBOLS),
        "n_marks": _without(text, "!"),
        "n_upper": _without(text, _UPPER),
    })
    word = lambda i, k: F.get(F.col("_words"), i + k)
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - 5), lambda i: F.xxhash64(*[word(i, k) for k in range(5)]))
    found = found.withColumn("_grams", F.when(F.size("_words") >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    found = found.withColumn("_any", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    ranked = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    found = found.withColumn("_ranked", F.when(F.col("_any"), ranked))
    same = lambda x, j: F.coalesce(F.get(F.col("_ranked"), j)["g"] == x["g"], F.lit(False))
    repeated = F.filter("_ranked", lambda x, j: same(x, j - 1) | same(x, j + 1))
    found = found.withColumn("_starts", F.when(F.col("_any"), F.array_sort(F.transform(repeated, lambda x: x["i"]))))
    gap = lambda x, j: F.least(F.coalesce(F.get(F.col("_starts"), j + 1) - x, F.lit(5)), F.lit(5))
    covered = F.aggregate(F.transform("_starts", gap), F.lit(0), lambda a, x: a + x)
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    found = found.withColumns({
        "n_words": long(F.size("_words")),
        "word_chars": long(F.col("word_chars")),
        "n_symbols": long(F.col("n_symbols")),
        "n_lines": long(F.size("_lines")),
        "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_repeat_words": long(F.when(F.col("_any"), covered)),
        # A filter on statistics that also names this column stays above them; pushed below, it would work them out again.
        "_at": F.monotonically_increasing_id(),
    })
    return found.drop("_words", "_lines", "_grams", "_any", "_ranked", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _best_condition(x: np.ndarray, bad: np.ndarray, held: np.ndarray):
    """The threshold that gains most information about the bad among the rows ``held``."""
    p0, n0 = (bad & held).sum(), (~bad & held).sum()
    if not p0 or not n0:
        return None
    best, found = 0.0, None
    for k in range(x.shape[1]):
        values = x[held, k]
        order = np.argsort(values, kind="stable")
        v, y = values[order], bad[held][order]
        edge = np.flatnonzero(np.diff(v) > 0)
        below = np.cumsum(y)[edge], np.cumsum(~y)[edge]
        for least, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
            if len(gain) and (i := int(np.argmax(gain))) >= 0 and gain[i] > best:
                best, found = float(gain[i]), (k, least, float((v[edge[i]] + v[edge[i] + 1]) / 2))
    return found


def _holds(x: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, least, value in conditions:
        out &= x[:, k] >= value if least else x[:, k] <= value
    return out


def learn(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """An ordered list of rules that reject bad rows, by growing and pruning one conjunction at a time."""
    grow = np.arange(len(x)) % 3 != 0
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    precise = lambda m: (m & bad).sum() / max(1, m.sum())
    while len(rules) < MOST_RULES:
        conditions: list[tuple[int, bool, float]] = []
        while len(conditions) < MOST_CONDITIONS:
            held = _holds(x, conditions) & left & grow
            more = _best_condition(x, bad, held)
            if more is None:
                break
            conditions.append(more)
        if not conditions:
            break
        prune = left & ~grow
        worth = lambda c: (lambda m: (2.0 * (m & bad).sum() - m.sum()) / max(1, m.sum()))(_holds(x, c) & prune)  # noqa: B023, E731
        best = max((conditions[:k] for k in range(1, len(conditions) + 1)), key=lambda c: (worth(c), -len(c)))
        covered = _holds(x, best) & left
        if covered.sum() < MIN_COVERED or min(precise(covered & grow), precise(covered), precise(_holds(x, best))) < MIN_PRECISION:
            break
        rules.append(Rule(tuple((names[k], least, value) for k, least, value in best), float(precise(covered))))
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[Rule]:
    """Rules from the statistics of at most ``most`` labelled documents, those apart that the base rule rejects."""
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # The sample is bounded by ``most`` rows of two numbers, so it may be broadcast.
    taken = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    shown = statistics(taken).select("doc_id", "quality", base_failed().alias("failed"), *[c.alias(n) for n, c in features().items()])
    rows = sorted((r for r in shown.collect() if not r["failed"]), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15) % 2**64)
    if not rows:
        return []
    names = list(features())
    x = np.array([[r[n] for n in names] for r in rows], float)
    return learn(x, np.array([r["quality"] == 0 for r in rows]), names)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics of every row, base_failed, the number of the rule that rejects it (null if none), and kept."""
    found = statistics(docs)
    own = {f"_f_{n}": c for n, c in features().items()}
    found = found.withColumns(own).withColumn("base_failed", base_failed())
    which = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        held = Rule(tuple((f"_f_{n}", least, v) for n, least, v in rule.conditions), rule.precision)
        which = F.when(held.column(), F.lit(k)).otherwise(which)
    found = found.withColumn("rule", which)
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*own)


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    rules = fit(docs, labels)
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    return judged(plain, rules).where("kept and _at >= 0").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, common.table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
