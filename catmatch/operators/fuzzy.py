"""Approximate term matching: words against a vocabulary by edit distance.

Words are made distinct first, then meet the vocabulary through shared blocking
keys in an equi-join; the exact distance runs only on pairs that share a key, in the JVM.
Short terms share deletion keys, long ones a fifth of their letters, so the
number of keys per word stays small whatever its length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catmatch.functions import text as tx
from catmatch.functions.distance import may_be_close, small_distance, with_deletion_keys
from catmatch.operators.ranking import keep_within, top_k
from catmatch.sources.tables import keep, slots

LONG = 22  # vocabulary terms above this length are blocked by segments
#: Letters from which others are left out to make a key: words that are near share a key of their beginnings too, as
#: whoever has lost fewer letters there can leave out the last ones. So a word has 37 keys at most, whatever its length.
HEAD = 8


def edit_limit(word: Column) -> Column:
    """Edits allowed for catalogue terms: none for short words and numbers."""
    size = F.length(word)
    return (F.when((size <= 3) | word.rlike(r"^\p{N}+$"), 0).when(size <= 5, 1).otherwise(2))


def producer_edit_limit(word: Column) -> Column:
    return F.when(F.length(word) >= 8, 2).otherwise(0)


def _segment_keys_of_term(term: Column) -> Column:
    """Five consecutive pieces: two edits, swaps included, touch at most four of them."""
    size = F.length(term)
    starts = F.sequence(F.lit(0), F.lit(4))
    bound = lambda i: F.floor(size * i / 5).cast("int")
    return F.transform(starts, lambda i: F.concat_ws(
        ":", size.cast("string"), i.cast("string"),
        F.substring(term, bound(i) + 1, bound(i + 1) - bound(i))))


def _segment_keys_of_word(word: Column) -> Column:
    """The pieces every term within two edits could still have in this word."""
    size = F.length(word)
    sizes = F.sequence(F.greatest(size - 2, F.lit(LONG + 1)), F.greatest(size + 2, F.lit(LONG + 1)))

    def pieces(length):
        bound = lambda i: F.floor(length * i / 5).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.transform(
            F.sequence(F.greatest(bound(i) - 2, F.lit(0)), bound(i) + 2),
            lambda at: F.concat_ws(":", length.cast("string"), i.cast("string"),
                                   F.substring(word, at + 1, bound(i + 1) - bound(i))))))

    return F.array_distinct(F.flatten(F.transform(sizes, pieces)))


def term_keys(vocabulary: DataFrame) -> DataFrame:
    """(key, term): by which words near a term find it. A term pairs with words of either budget, so it has the keys of two deletions."""
    terms = vocabulary.select("term", F.length("term").alias("size"))
    heads = terms.filter(F.col("size").between(3, LONG)).select("term", F.substring("term", 1, HEAD).alias("head"), F.lit(2).alias("budget"))
    short = with_deletion_keys(heads, "head", "budget")
    long = terms.filter(F.col("size") > LONG).select("term", F.explode(_segment_keys_of_term(F.col("term"))).alias("key"))
    return short.select("key", "term").unionByName(long.select("key", "term")).distinct()


def word_keys(words: DataFrame) -> DataFrame:
    """(word, budget) → (key, word, budget)."""
    size = F.length("word")
    heads = words.filter(size <= LONG + 2).withColumn("head", F.substring("word", 1, HEAD))
    short = with_deletion_keys(heads, "head", "budget").select("key", "word", "budget")
    long = words.filter(size >= LONG - 1).withColumn("key", F.explode(_segment_keys_of_word(F.col("word"))))
    return short.unionByName(long.select("key", "word", "budget"))


def close_terms(words: DataFrame, vocabulary: DataFrame, limit_of=edit_limit, per_word: int = 4, keys: DataFrame | None = None) -> DataFrame:
    """(word, term, distance): the nearest vocabulary terms within each word's edit limit.

    `words` and `vocabulary` are distinct in their single column (word, term); `keys` are the
    vocabulary's term_keys, where an index holds them.
    At most `per_word` terms are kept per word, nearest first, then by term.
    """
    # Few bytes but much work per word: keep one task per slot whatever the size.
    rows = words.repartition(slots(words)).select("word", limit_of(F.col("word")).alias("budget"))
    terms = vocabulary.select("term", F.length("term").alias("size"))
    exact = rows.join(terms.select(F.col("term")), F.col("word") == F.col("term")).select(
        "word", "term", F.lit(0).alias("distance"))

    # A word more than two letters longer than every term has no partner.
    longest = terms.agg(F.max("size")).scalar()
    inexact = rows.filter((F.col("budget") > 0) & (F.length("word") - 2 <= longest))
    pairs = word_keys(inexact).join(term_keys(vocabulary) if keys is None else keys, "key")
    near = (F.abs(F.length("word") - F.length("term")) <= F.col("budget")) & (F.col("word") != F.col("term"))
    pairs = pairs.filter(near & may_be_close(F.col("word"), F.col("term"))).groupBy("word", "term").agg(F.max("budget").alias("budget"))
    within = F.filter(F.array(small_distance(F.col("word"), F.col("term"))), lambda d: d <= F.col("budget"))
    # A row for a distance within the budget: a filter by it would be moved before the pairs are made distinct, and measure twice.
    measured = pairs.select("word", "term", F.explode(within).alias("distance"))
    found = exact.unionByName(measured)
    return top_k(found, ["word"], [F.col("distance"), F.col("term")], per_word, "_n").drop("_n")


def variants_of(words: DataFrame) -> DataFrame:
    """(raw, word, method, prior): readings of each distinct raw word."""
    terms = F.transform(tx.reading_forms(F.col("word")), lambda w: tx.resolve_alias(tx.transliterate(w)))
    return (words.select(F.col("word").alias("raw"), terms.alias("terms"))
            .select("raw", F.explode(tx.variants_from_terms(F.col("terms"))).alias("v"))
            .select("raw", F.col("v.term").alias("word"), "v.method", "v.prior"))


def term_matches(words: DataFrame, vocabulary: DataFrame, joined: DataFrame | None = None,
                 floor: float = 0.73, delta: float = 0.08, limit: int = 5, keys: DataFrame | None = None) -> DataFrame:
    """(raw, term, method, distance, similarity, match_strength) per distinct raw word."""
    readings = keep(variants_of(words))  # many small steps a word, read three times
    near = close_terms(readings.select("word").distinct(), vocabulary, keys=keys)
    longest = F.greatest(F.length("word"), F.length("term"))
    similarity = 1 - F.col("distance") / longest
    hits = readings.join(near, "word").withColumn("similarity", similarity).filter(
        F.col("similarity") >= floor).select(
        "raw", "term", "method", "distance", "similarity",
        (F.col("similarity") * F.col("prior")).alias("match_strength"))
    if joined is not None:
        whole = readings.join(joined, F.col("word") == F.col("joined")).select(
            "raw", F.explode("parts").alias("term"), F.lit("joined").alias("method"),
            F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"),
            (0.96 * F.col("prior")).alias("match_strength"))
        hits = hits.unionByName(whole)
    rest = F.struct("method", "distance", "similarity", "match_strength")
    best = hits.groupBy("raw", "term").agg(
        F.max_by(rest, F.struct("match_strength", -F.col("distance"))).alias("m")).select("raw", "term", "m.*")
    return keep_within(best, ["raw"], "match_strength", "term", delta, limit)


def joined_phrases(rows: DataFrame, texts: list[str], vocabulary: DataFrame) -> DataFrame:
    """(joined, parts): runs of 2-3 catalogue words written as one, if unambiguous and new."""
    def runs(words, n):
        return F.when(F.size(words) >= n, F.transform(
            F.sequence(F.lit(0), F.size(words) - n), lambda i: F.slice(words, i + 1, n)))

    each = [runs(tx.tokens(name), n) for name in texts for n in (2, 3)]
    every = F.flatten(F.filter(F.array(*each), lambda r: r.isNotNull()))
    parts = rows.select(F.explode(every).alias("parts")).distinct().withColumn(
        "joined", F.array_join("parts", ""))
    parts = parts.filter((F.length("joined") >= 7) & F.forall("parts", lambda w: F.length(w) >= 3))
    lone = parts.groupBy("joined").agg(F.count(F.lit(1)).alias("n"), F.first("parts").alias("parts")).filter("n = 1")
    return lone.join(vocabulary.select(F.col("term").alias("joined")), "joined", "left_anti").select("joined", "parts")
