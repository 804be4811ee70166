"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule votes good (1), bad (-1) or abstains (0) on a document's statistics. Documents are
counted by their pattern of votes (at most 3 ** rules patterns, whatever the corpus);
expectation-maximisation over the counts estimates how often each rule votes good and bad in good
and in bad documents, and how common good documents are. A document's posterior then replaces all-must-pass rules.
Only Spark expressions are used; the driver holds four rates a rule.

Defined cases: a null or empty text has no words and fails the base check; repeated rows are
judged one by one; a null doc_id is kept; without documents, or where no rule votes, the
starting rates stand; an empty table gives no rows; other columns are ignored, or kept
by `keep_good`.
"""
from __future__ import annotations

import math
import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catmatch.llm.common import WORD_GAP, materialize, shared_folder

SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_FROM = 0.5
EM_ROUNDS = 20
SHARE_START, SHARE_RANGE = 0.8, (0.05, 0.98)
#: Rates of good and bad votes in (good, bad) documents before any count, and the documents they weigh as much as.
GOOD_VOTES_START, BAD_VOTES_START, PRIOR_WEIGHT = (0.9, 0.7), (0.02, 0.4), 50
#: Function words of the four languages of the corpus.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "de", "la", "le", "et", "que", "el", "en", "y", "los", "der", "die",
              "und", "zu", "den", "les", "des"]


class Votes(NamedTuple):
    """A rule: good up to one bound of a ratio, bad from another, silent between."""
    name: str
    ratio: str
    good_to: float
    bad_from: float


RULES = [
    Votes("symbols", "n_symbols / n_words", 0.05, 0.30),
    Votes("repeats", "n_repeat_words / n_words", 0.20, 0.40),
    Votes("duplicate_lines", "n_dup_lines / n_lines", 0.20, 0.50),
    Votes("capitals", "n_capitals / word_chars", 0.15, 0.40),
    Votes("exclamations", "n_exclamations / n_words", 0.10, 0.30),
    Votes("word_length", "abs(word_chars / n_words - 5.5)", 3.0, 5.0),
    Votes("stop_words_missing", "1 - n_stop_words / n_words", 0.90, 0.97),
    Votes("doubled_words", "n_doubled / n_words", 0.05, 0.20),
]


class Model(NamedTuple):
    """P(good), and for each rule how likely its good and its bad vote are in either class."""
    share: float
    good_votes: tuple[tuple[float, float], ...]  # P(votes good | good), P(votes good | bad)
    bad_votes: tuple[tuple[float, float], ...]  # P(votes bad | good), P(votes bad | bad)


def _found(character_class: str) -> Column:
    """How many characters of the class the text holds."""
    return F.regexp_count("text", F.lit(character_class)).cast("long")


def add_statistics(docs: DataFrame) -> DataFrame:
    """docs as one struct column `row`, and `stats`: a struct of counts of the whole text."""
    words = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "words", F.array_remove(F.split("text", WORD_GAP), ""))
    hashed = words.withColumn("hashes", F.transform(
        F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    # Only a text in which a window repeats has its windows sorted; elsewhere no word is covered.
    windows = hashed.withColumn("windows", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    # Places of windows that equal a neighbour in hash order; each covers up to three words not yet covered.
    places = windows.withColumn("places", F.sort_array(F.transform(F.filter("windows", lambda w, k: (
        F.get("windows", k - 1)["h"].eqNullSafe(w["h"]) | F.get("windows", k + 1)["h"].eqNullSafe(w["h"]))), lambda w: w["at"])))
    lines = places.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda line: F.rlike(line, F.lit(WORD))))
    covered = F.aggregate(F.transform("places", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - at, F.lit(3)))),
                          F.lit(0).cast("long"), lambda total, n: total + n)
    size = lambda array: F.size(array).cast("long")
    return lines.select("row", F.struct(
        size("words").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _found(f"[{SYMBOLS}]").alias("n_symbols"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        size("lines").alias("n_lines"),
        _found("[A-Z]").alias("n_capitals"),
        _found("!").alias("n_exclamations"),
        size(F.filter("words", lambda w: w.isin(STOP_WORDS))).alias("n_stop_words"),
        size(F.filter("words", lambda w, k: w.eqNullSafe(F.get("words", k - 1)))).alias("n_doubled")).alias("stats"))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def add_votes(counted: DataFrame, rules: list[Votes] = RULES) -> DataFrame:
    """row, stats → row, stats, votes: an array of 1, -1 or 0 a rule; all abstain where there are no words."""
    ratios = [F.expr(f"CASE WHEN stats.n_words > 0 THEN {_of_stats(rule.ratio)} END").cast("double") for rule in rules]
    ratio = [F.get("ratios", F.lit(k)) for k in range(len(rules))]
    return counted.withColumn("ratios", F.array(*ratios)).select("row", "stats", F.array(*[
        F.when(r <= rule.good_to, 1).when(r >= rule.bad_from, -1).otherwise(0).cast("byte")
        for r, rule in zip(ratio, rules)]).alias("votes"))


def _of_stats(ratio: str) -> str:
    return re.sub(r"\b(n_\w+|word_chars)\b", r"stats.\1", ratio)


def log_odds(votes: Column, model: Model) -> Column:
    """Of good against bad. A vote never speaks against itself; abstaining says nothing."""
    total = F.lit(math.log(model.share / (1 - model.share)))
    for k, (good, bad) in enumerate(zip(model.good_votes, model.bad_votes)):
        vote = F.get(votes, F.lit(k))
        total = total + (F.when(vote == 1, max(0.0, math.log(good[0] / good[1])))
                         .when(vote == -1, min(0.0, math.log(bad[0] / bad[1]))).otherwise(0.0))
    return total


def posterior(votes: Column, model: Model) -> Column:
    return 1 / (1 + F.exp(-log_odds(votes, model)))


def fit(votes: DataFrame, n_rules: int = len(RULES), rounds: int = EM_ROUNDS) -> Model:
    """Expectation-maximisation over a frame with a `votes` column."""
    patterns = materialize(votes.groupBy("votes").agg(F.count("*").alias("n")))
    model = Model(SHARE_START, (GOOD_VOTES_START,) * n_rules, (BAD_VOTES_START,) * n_rules)
    good, bad = F.col("n") * F.col("good"), F.col("n") * (1 - F.col("good"))
    voted = [(k, said) for k in range(n_rules) for said in (1, -1)]
    for _ in range(rounds):
        weighed = patterns.withColumn("good", posterior(F.col("votes"), model))
        sums = weighed.agg(F.sum(good), F.sum(bad), *[
            F.sum(F.when(F.get("votes", F.lit(k)) == said, mass).otherwise(0.0)) for k, said in voted for mass in (good, bad)]).first()
        if sums[0] is None:
            break
        of_good, of_bad = sums[0], sums[1]
        share = min(max(of_good / (of_good + of_bad), SHARE_RANGE[0]), SHARE_RANGE[1])
        rates = {}
        for at, (k, said) in enumerate(voted):
            start = GOOD_VOTES_START if said == 1 else BAD_VOTES_START
            rates[k, said] = tuple((votes_in + PRIOR_WEIGHT * p) / (mass + PRIOR_WEIGHT) for votes_in, mass, p in zip(
                sums[2 + 2 * at:4 + 2 * at], (of_good, of_bad), start))
        old, model = model, Model(share, tuple(rates[k, 1] for k in range(n_rules)), tuple(rates[k, -1] for k in range(n_rules)))
        if abs(model.share - old.share) < 1e-6:
            break
    return model


def judge_quality(docs: DataFrame) -> DataFrame:
    """row (with doc_id), stats, votes, base_failed, good (the posterior) and kept for every document row."""
    voted = materialize(add_votes(add_statistics(docs.select("doc_id", "text")))
                        .select(F.struct("row.doc_id").alias("row"), "stats", "votes"))
    return _decided(voted, fit(voted))


def _decided(voted: DataFrame, model: Model) -> DataFrame:
    failed = base_failed(F.col("stats"))
    good = posterior(F.col("votes"), model)
    return voted.select("row", "stats", "votes", failed.alias("base_failed"), good.alias("good"),
                        (~failed & (good >= KEEP_FROM)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, unchanged.

    Statistics are made once: votes and the rows that pass the base check are written in the shared folder, where
    removing them is the caller's; the fit reads the votes alone, the answer the rows.
    """
    voted = add_votes(add_statistics(docs))
    path = f"{shared_folder(docs.sparkSession)}/judged-{uuid.uuid4().hex}"
    voted.select(F.when(~base_failed(F.col("stats")), F.col("row")).alias("row"), "votes").write.parquet(path)
    judged = docs.sparkSession.read.parquet(path)
    model = fit(judged.select("votes"))
    return judged.filter(F.col("row").isNotNull() & (posterior(F.col("votes"), model) >= KEEP_FROM)).select("row.*")
