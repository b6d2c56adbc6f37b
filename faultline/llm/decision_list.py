"""Learned decision lists over text statistics: all Spark expressions, no Python on the executors.

Statistics of whole texts come from built-in array and string functions. Rules are learned by sequential covering from
labelled rows: a rule is grown, one threshold condition at a time, for the largest information gain on two thirds of
the rows still uncovered, then its last conditions are pruned while that doesn't hurt on the other third; a rule that
isn't precise there ends the list. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Labelled rows that are used at most, those with the least hashes of their ids.
SAMPLE = 8000
MIN_PRECISION, MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 0.85, 24, 4, 48
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "line_length", "letter_share")


def _removed(text: Column, chars: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds the base statistics (long) and the features that rules look at (double) to docs.

    Words are runs of other than ASCII white space. n_repeat_words counts words inside windows of five words that the
    text has twice or more, the first included: window hashes are sorted with their places, equal neighbours give the
    places, and each place adds what the one before doesn't cover. Null and empty texts have no words; all shares of
    nothing are 0. Columns of docs with a clashing name are replaced.
    """
    made = ["_body", "_words", "_lines", "_hashes", "_windows", "_sorted", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES]
    kept = [c for c in docs.columns if c.lower() not in made or c == text_column]
    body = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    split = F.split(F.btrim(F.col("_body"), F.lit(SPACES)), r"[\x20\x09-\x0D]+")
    rows = docs.select(*kept, body.alias("_body"))
    rows = rows.withColumn("_words", F.when(F.btrim(F.col("_body"), F.lit(SPACES)) == "", F.array().cast("array<string>")).otherwise(split))
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
            "_lines": F.filter(F.split("_body", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
            "_spaces": _removed(F.col("_body"), SPACES),
            "n_symbols": _removed(F.col("_body"), SYMBOLS),
            "_upper": _removed(F.col("_body"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_digits": _removed(F.col("_body"), "0123456789"),
            "_marks": _removed(F.col("_body"), "!?|=@\\{}[]"),
        }
    )
    count = (F.col("n_words") - (WINDOW - 1)).cast("int")
    shifted = [F.slice("_hashes", F.lit(k + 1), count).alias(f"h{k}") for k in range(WINDOW)]
    rows = rows.withColumns(
        {
            "_windows": F.when(F.col("n_words") >= WINDOW, F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(z))).otherwise(F.array().cast("array<bigint>")),
            "word_chars": F.length("_body").cast("long") - F.col("_spaces"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_distinct": F.size(F.array_distinct("_hashes")),
        }
    )
    # Only texts with a repeated window sort theirs.
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(repeated, F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))))
    n = F.size("_sorted")
    none = F.array(F.lit(None).cast("struct<h:bigint,at:int>"))
    trio = F.arrays_zip(F.col("_sorted").alias("s"), F.concat(none, F.slice("_sorted", F.lit(1), n - 1)).alias("p"), F.concat(F.slice("_sorted", F.lit(2), n - 1), none).alias("q"))
    places = F.array_sort(F.transform(F.filter(trio, lambda z: F.coalesce(z["s"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["s"]["h"] == z["q"]["h"], F.lit(False))), lambda z: z["s"]["at"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda acc, at: F.struct(at.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    rows = rows.withColumn("n_repeat_words", F.when(F.col("_sorted").isNotNull(), covered).otherwise(F.lit(0)).cast("long"))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))

    chars, lines = F.col("word_chars"), F.size("_lines")
    rows = rows.withColumns(
        {
            "word_length": share(chars, F.col("n_words")),
            "symbol_share": share(F.col("n_symbols"), chars),
            "dup_line_share": share(F.col("n_dup_lines"), lines),
            "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
            "distinct_share": share(F.col("_distinct"), F.col("n_words")),
            "upper_share": share(F.col("_upper"), chars),
            "digit_share": share(F.col("_digits"), chars),
            "mark_share": share(F.col("_marks"), chars),
            "line_length": share(F.col("n_words"), lines),
            "letter_share": share(chars - F.col("_digits") - F.col("n_symbols") - F.col("_marks"), chars),
        }
    )
    return rows.select(*[c for c in kept], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f for f in FEATURES if f != "n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    threshold: float

    def holds(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        values = x[:, names.index(self.feature)]
        return values <= self.threshold if self.at_most else values >= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) <= F.lit(self.threshold) if self.at_most else F.col(self.feature) >= F.lit(self.threshold)


@dataclass
class DecisionList:
    """Rules for low quality, in order; a row that none matches is good."""

    names: tuple[str, ...] = FEATURES
    rules: list[list[Condition]] = field(default_factory=list)

    def column(self) -> Column:
        """The number of the first rule that matches, from 1 on; 0 where none does."""
        out: Column | None = None
        for k, rule in enumerate(self.rules, 1):
            test = rule[0].column()
            for condition in rule[1:]:
                test &= condition.column()
            out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def text(self) -> str:
        lines = [f"{k}. bad if " + " and ".join(f"{c.feature} {'<=' if c.at_most else '>='} {c.threshold:.6g}" for c in rule) for k, rule in enumerate(self.rules, 1)]
        return "\n".join([*lines, "else good"])


def learn(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = FEATURES, seed: int = 0) -> DecisionList:
    """Sequential covering on rows x with labels `bad`; deterministic for a seed."""
    out = DecisionList(names)
    order = np.random.default_rng(seed).permutation(len(x))
    grow, prune = order[: 2 * len(x) // 3], order[2 * len(x) // 3 :]
    while len(out.rules) < MAX_RULES and bad[grow].any():
        rule: list[Condition] = []
        covered = np.ones(len(grow), bool)
        while len(rule) < MAX_CONDITIONS and (covered & ~bad[grow]).any():
            best = _best(x[grow][covered], bad[grow][covered], names)
            if best is None:
                break
            rule.append(best)
            covered &= best.holds(x[grow], names)
        if not rule:
            break

        def worth(some: list[Condition]) -> tuple[float, int, int]:
            hit = np.ones(len(prune), bool)
            for condition in some:
                hit &= condition.holds(x[prune], names)
            p, n = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
            return (p - n) / (p + n) if p + n else -1.0, p, n

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule = rule[:-1]
        _, p, n = worth(rule)
        if p < 2 or p < MIN_PRECISION * (p + n):
            break
        out.rules.append(rule)

        def left(rows: np.ndarray, rule: list[Condition] = rule) -> np.ndarray:
            hit = np.ones(len(rows), bool)
            for condition in rule:
                hit &= condition.holds(x[rows], names)
            return rows[~hit]

        grow, prune = left(grow), left(prune)
    return out


def _best(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> Condition | None:
    """The condition of the largest gain: covered bad rows times what they get purer by."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    if not p0:
        return None
    start = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for k, name in enumerate(names):
        for t in np.unique(np.quantile(x[bad, k], np.linspace(0, 1, THRESHOLDS), method="nearest")):
            for at_most in (True, False):
                hit = x[:, k] <= t if at_most else x[:, k] >= t
                p = int((hit & bad).sum())
                n = int(hit.sum()) - p
                if p >= 2 and p + n < len(x):
                    gain = p * (np.log2(p / (p + n)) - start)
                    if gain > best:
                        best, found = gain, Condition(name, at_most, float(t))
    return found


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """Learns from at most `sample` labelled documents that pass the base rules.

    Rows without a label or an id aren't used, null texts have no words and so fail the base rules. Of several labels of
    an id the least counts; repeated rows of a labelled id each count. Of equal gains the first feature and threshold
    wins, so the list is the same whenever it is learned. Without any labelled row, or an empty table, the list is empty
    and all that passes the base rules is good.
    """
    known = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label")).where("_id is not null and _label is not null").groupBy("_id").agg(F.min("_label").alias("_label"))
    present = known.join(docs.select(F.col(id_column).alias("_id")).distinct(), "_id", "left_semi")
    drawn = present.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text")).join(F.broadcast(drawn), "_id")
    # The base rules are applied here: a filter on statistics would be pushed below them, each use computed anew.
    got = statistics(rows).select("_id", "_label", "n_repeat_words", *FEATURES).collect()
    got = sorted((r for r in got if r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]), key=lambda r: r["_id"])
    x = np.array([[float(r[f]) for f in FEATURES] for r in got]).reshape(len(got), len(FEATURES))
    return learn(x, np.array([r["_label"] == 0 for r in got], bool))


def apply(docs: DataFrame, rules: DecisionList, text_column: str = "text") -> DataFrame:
    """docs with statistics, base_failed, rule (the first that matches, 0: none) and kept.

    A row for each input row, repeated ones alike; null and empty texts fail the base rules; a value equal to a
    threshold is on the side that the rule's condition says; an empty table gives no rows.
    """
    out = statistics(docs, text_column).withColumn("base_failed", base_failed()).withColumn("rule", rules.column())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
