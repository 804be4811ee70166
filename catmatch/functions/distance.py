"""Unrestricted Damerau-Levenshtein distance and its blocking keys."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType


def damerau_distance(left: str, right: str) -> int:
    """Edit distance where swapped letters may have edits between them."""
    if left == right:
        return 0
    last_row: dict[str, int] = {}
    big = len(left) + len(right)
    width = len(right) + 2
    table = [[big] * width, [big, *range(len(right) + 1)]]
    for i, a in enumerate(left, 1):
        row, previous, match_col = [big, i], table[i], 0
        for j, b in enumerate(right, 1):
            swap_row, swap_col = last_row.get(b, 0), match_col
            if a == b:
                best, match_col = previous[j], j
            else:
                best = 1 + min(previous[j], row[j], previous[j + 1])
            swap = table[swap_row][swap_col] + (i - swap_row - 1) + 1 + (j - swap_col - 1)
            row.append(min(best, swap))
        table.append(row)
        last_row[a] = i
    return table[-1][-1]


@F.pandas_udf(IntegerType())
def damerau_levenshtein(left: pd.Series, right: pd.Series) -> pd.Series:
    """Arrow-batched distance; only meant for pairs that already share a blocking key."""
    return pd.Series([damerau_distance(a, b) for a, b in zip(left, right)], dtype="int32")


def adjacent_swaps(word: Column) -> Column:
    """All strings one swap of neighbouring letters away."""
    def swap(i):
        return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)),
                        F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word)))

    return F.when(F.length(word) >= 2, F.transform(
        F.sequence(F.lit(1), F.length(word) - 1), swap)).otherwise(F.array().cast("array<string>"))


def letters_apart(left: Column, right: Column) -> Column:
    """Letters of either word that the other has not, and the difference of their lengths: a swap changes nothing, another operation 2 at most."""
    strange = lambda a, b: F.length(F.call_function("translate", a, b, F.lit("")))
    return strange(left, right) + strange(right, left) + F.abs(F.length(left) - F.length(right))


def may_be_close(left: Column, right: Column) -> Column:
    """False only where the distance is above 2: at most two plain operations, or a swap with another."""
    return (F.levenshtein(left, right, 2) >= 0) | ((letters_apart(left, right) <= 2) & (F.levenshtein(left, right, 4) >= 0))


def small_distance(left: Column, right: Column) -> Column:
    """The Damerau-Levenshtein distance where it is at most 2, else null; JVM only.

    Two operations pass through one string in between: without swaps the plain
    distance counts them, otherwise a swap comes first, last or both times. Swaps
    are only tried where the letters allow them.
    """
    def of(plain):
        before, after = adjacent_swaps(left), adjacent_swaps(right)
        apart = letters_apart(left, right)
        two = (F.exists(before, lambda s: F.levenshtein(s, right, 1) >= 0)
               | F.exists(after, lambda s: F.levenshtein(left, s, 1) >= 0) | F.arrays_overlap(before, after))
        return (F.when(plain < 0, F.lit(None)).when(plain <= 1, plain)
                .when(plain == 2, F.when((apart == 0) & F.array_contains(before, right), 1).otherwise(2))
                .when((apart <= F.when(plain == 3, 2).otherwise(0)) & two, F.lit(2)))

    return F.get(F.transform(F.array(F.levenshtein(left, right, 4)), of), 0)  # the plain distance once


def deletions(word: str, budget: int) -> set[str]:
    """All strings left after up to `budget` (0, 1 or 2) deletions: what with_deletion_keys makes in Spark."""
    keys = layer = {word}
    for _ in range(budget):
        layer = {w[:i] + w[i + 1:] for w in layer for i in range(len(w))}
        keys = keys | layer
    return keys


def with_deletion_keys(df: DataFrame, word: str, budget: str) -> DataFrame:
    """Rows of df with a `key` for every string left of a word after up to `budget` (0, 1 or 2) deletions.

    Two words within distance d share at least one key for budget d on each
    side: every edit, a swap included, is undone by one deletion on each side.
    The letters to leave out are rows of their own, so that the strings are cut in
    generated code; a word with a letter doubled has some keys twice.
    """
    w, size = F.col(word), F.length(word)
    one = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.when(F.col(budget) >= 1, size).otherwise(0))))
    more = (F.col(budget) >= 2) & (F.col("_i") >= 1) & (F.col("_i") < size)
    two = one.withColumn("_j", F.explode(F.sequence(F.col("_i"), F.when(more, size).otherwise(F.col("_i")))))
    i, j = F.col("_i"), F.col("_j")
    cut = F.concat(F.substring(w, F.lit(1), i - 1), F.when(j > i, F.substring(w, i + 1, j - i - 1)).otherwise(F.lit("")),
                   F.substring(w, F.greatest(i, j) + 1, size))
    return two.withColumn("key", F.when(i == 0, w).otherwise(cut)).drop("_i", "_j")
