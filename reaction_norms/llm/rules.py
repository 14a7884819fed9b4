"""Quality rules by weak supervision (operator 4).

Each rule looks at counts of a whole text and votes for quality (1), against it (-1) or
abstains (0). Expectation-maximisation over the table of vote patterns (at most three to the
number of rules) estimates how often each rule is right and how many texts are good; a text is
kept when its posterior probability of quality reaches the threshold. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reaction_norms.llm.common import SPACE, SPACE_RUN, documents, stored

SYMBOLS = "#*$%&|<>"
MARKS = SYMBOLS + "!?.,;:()[]{}@^~_=+/\\"
THRESHOLD = 0.5


def counts(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``extra``, and per whole text: n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, n_upper, n_shouts, n_stops, n_marks,
    n_symbol_runs, n_pieces (distinct words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), *extra, text.alias("_t"))
    spread = F.split(F.btrim("_t", F.lit(SPACE)), SPACE_RUN)
    lines = F.filter(F.split("_t", "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    rows = rows.select("doc_id", *extra, "_t", spread.alias("_w"), lines.alias("_l"))
    n = F.when((F.size("_w") == 1) & (F.get("_w", F.lit(0)) == ""), 0).otherwise(F.size("_w"))
    # hash and place of each 3-word window, equal hashes side by side
    windows = F.transform("_w", lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))
    windows = F.sort_array(F.slice(windows, 1, F.greatest(F.size("_w") - 2, F.lit(0))))
    bare = F.length(F.translate("_t", SPACE, ""))
    rows = rows.select(
        "doc_id",
        *extra,
        n.cast("long").alias("n_words"),
        bare.cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑÓÍÁÚ", ""))).cast("long").alias("n_upper"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).cast("long").alias("n_shouts"),
        (F.length("_t") - F.length(F.translate("_t", ".?", ""))).cast("long").alias("n_stops"),
        (F.length("_t") - F.length(F.translate("_t", MARKS, ""))).cast("long").alias("n_marks"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_pieces"),
        windows.alias("_s"),
    )
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    places = F.transform(F.filter("_s", lambda x, k: same(x, F.get("_s", k - 1)) | same(x, F.get("_s", k + 1))), lambda x: x["i"])
    rows = rows.withColumn("_p", F.sort_array(places)).drop("_s")
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
    )["n"]
    return rows.withColumn("n_repeat_words", covered).drop("_p")


@dataclass(frozen=True)
class Rule:
    """Votes against quality where ``bad`` holds, for it where ``good`` holds."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.coalesce(F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1), F.lit(0)).alias(self.name)


RULES = (
    Rule("symbols", "n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    Rule("symbol_runs", "n_symbol_runs <= 0.02 * n_words", "n_symbol_runs > 0.2 * n_words"),
    Rule("marks", "n_marks <= 0.05 * word_chars", "n_marks > 0.08 * word_chars"),
    Rule("repeats", "10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("lines", "n_lines >= 3 and n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", "n_upper <= 0.1 * word_chars", "n_upper > 0.3 * word_chars"),
    Rule("shouts", "n_shouts <= 0.02 * n_words", "n_shouts > 0.2 * n_words"),
    Rule("lengths", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    # distinct words against the square root of all: alike for texts of any length
    Rule("variety", "n_pieces * n_pieces >= 16 * n_words", "n_pieces * n_pieces < 4 * n_words"),
    Rule("stops", "n_stops >= n_words / 100.0", "n_stops < n_words / 1000.0"),
)


@dataclass
class LabelModel:
    """Share of good texts, and per rule the chances (for, against) of its vote on good and on bad
    texts. ``accuracy`` is the share of a rule's votes that are right."""

    prior: float
    on_good: dict[str, tuple[float, float]]
    on_bad: dict[str, tuple[float, float]]

    def chances(self) -> list[float]:
        return [self.prior, *(x for side in (self.on_good, self.on_bad) for pair in side.values() for x in pair)]

    def accuracy(self, rule: str) -> float:
        right = self.prior * self.on_good[rule][0] + (1 - self.prior) * self.on_bad[rule][1]
        return right / (right + self.prior * self.on_good[rule][1] + (1 - self.prior) * self.on_bad[rule][0])

    def posterior(self) -> Column:
        score = F.lit(log(self.prior / (1 - self.prior)))
        for name, good in self.on_good.items():
            bad = self.on_bad[name]
            vote = F.col(name)
            silent = log((1 - sum(good)) / (1 - sum(bad)))
            score = score + F.when(vote > 0, log(good[0] / bad[0])).when(vote < 0, log(good[1] / bad[1])).otherwise(silent)
        return 1 / (1 + F.exp(-score))


def fit(votes: DataFrame, rules: list[str], rounds: int = 60, prior: float = 0.8) -> LabelModel:
    """Accuracies and prior by expectation-maximisation, on all rows through their vote patterns.

    Right and wrong votes for and against are counted apart, since a rule that nearly always
    votes for quality says little when it does. The start says that votes against are rare on
    good texts; the vote counts are smoothed by one. Without rows the model keeps its start.
    """
    patterns = stored(votes.groupBy(*rules).agg(F.count("*").alias("_n")).coalesce(1), "patterns")
    model = LabelModel(prior, dict.fromkeys(rules, (0.8, 0.02)), dict.fromkeys(rules, (0.4, 0.4)))
    p, n = F.col("_p"), F.col("_n")
    sums = [F.sum(n * p).alias("_good"), F.sum(n).alias("_all")]
    for r in rules:
        for vote, sign in (("for", 1), ("against", -1)):
            sums += [F.sum(F.when(F.col(r) == sign, n * p).otherwise(0.0)).alias(f"_good_{vote}_{r}"), F.sum(F.when(F.col(r) == sign, n * (1 - p)).otherwise(0.0)).alias(f"_bad_{vote}_{r}")]
    for _ in range(rounds):
        now = patterns.withColumn("_p", model.posterior()).agg(*sums).first()
        if not now["_all"]:
            break
        size = {"good": now["_good"], "bad": now["_all"] - now["_good"]}
        chance = lambda y, r: tuple((now[f"_{y}_{v}_{r}"] + 1) / (size[y] + 3) for v in ("for", "against"))  # noqa: E731, B023
        new = LabelModel(min(0.99, max(0.01, now["_good"] / now["_all"])), {r: chance("good", r) for r in rules}, {r: chance("bad", r) for r in rules})
        moved = max(abs(a - b) for a, b in zip(new.chances(), model.chances()))
        model = new
        if moved < 1e-4:
            break
    return model


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its counts, votes, quality (posterior probability), base_failed and kept.

    A null text counts as empty and fails the base. Ties in posterior are equal results for
    equal votes. Repeated rows are judged alike. No rows: no rows. Of extra columns only those
    named in ``extra`` are read.
    """
    names = [r.name for r in rules]
    rows = counts(docs, extra)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(rows.select("*", *[r.vote() for r in rules], failed.alias("base_failed")), "votes")
    model = fit(rows, names)
    quality = model.posterior()
    return rows.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op4_rules(spark, sf_dir) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
