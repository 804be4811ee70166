"""Whole-word phrase tagging where the longest phrase wins, and label profiles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from catmatch import fixed_values as fv
from catmatch.functions import scalars as sc, text as tx
from catmatch.sources.tables import keep, lookup

ATTRIBUTES = ["color", "sweetness", "grapes", "producer"]


def phrase_table(spark: SparkSession, kind: str, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Rows (kind, value, phrase, phrase_order) of a small fixed vocabulary, phrases normalised."""
    rows, seen = [], set()
    for value, spellings in vocabulary.items():
        for phrase in [value, *spellings]:
            key = tx.py_normalize_phrase(phrase)
            if key and key not in seen:
                seen.add(key)
                rows.append((kind, value, key, len(rows)))
    return spark.createDataFrame(rows, "kind string, value string, phrase string, phrase_order int")


def phrases_of(values: DataFrame, kind: str, value: str = "value", base: int = 1000) -> DataFrame:
    """Phrase rows of a vocabulary that is itself a table (one value per row)."""
    phrase = tx.normalize_phrase(F.col(value))
    return values.select(F.lit(kind).alias("kind"), F.col(value).alias("value"), phrase.alias("phrase"),
                         F.lit(base).alias("phrase_order")).filter("phrase <> ''").dropDuplicates(["kind", "phrase"])


def reliable_lines(lines: DataFrame, floor: float, ceiling: float = 1.0) -> DataFrame:
    """Lines on the target (or not known to be off it) with a finite confidence in range."""
    confidence = F.col("confidence").try_cast("double")
    return lines.filter(F.coalesce("on_target", F.lit(True)) & ~F.isnan(confidence)
                        & confidence.between(floor, ceiling))


def longest_phrase(vocabulary: DataFrame) -> Column:
    """Words of the vocabulary's longest phrase."""
    return F.coalesce(vocabulary.agg(F.max(F.size(F.split("phrase", " ")))).scalar(), F.lit(1))


def _grams(words: Column, longest: Column) -> Column:
    """array<struct<first, after, gram>> of all word runs up to the longest phrase."""
    size = F.size(words)

    def of_length(n):
        return F.transform(F.sequence(F.lit(0), size - n), lambda i: F.struct(
            i.alias("first"), (i + n).alias("after"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram")))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.least(size, longest)), of_length))


def accept_longest(matches: Column) -> Column:
    """Matches kept greedily, longest phrase first, none overlapping one kept before."""
    ordered = F.array_sort(matches)
    nothing = F.filter(ordered, lambda m: F.lit(False))

    def overlaps(a, b):
        return (a["first"] < b["after"]) & (b["first"] < a["after"])

    return F.aggregate(ordered, nothing, lambda kept, m: F.when(
        F.exists(kept, lambda k: overlaps(k, m)), kept).otherwise(F.array_append(kept, m)))


def _match_struct() -> Column:
    return F.struct((-F.length("phrase")).alias("shorter"), "phrase_order", "first", "after", "value")


def find_values(rows: DataFrame, keys: list[str], text: str, vocabulary: DataFrame) -> DataFrame:
    """(keys, kind, value): vocabulary values of each text, longest phrase first.

    Word runs meet the vocabulary in an equi-join, so the vocabulary may be a
    large table; only runs that are a phrase are shuffled to their text.
    """
    vocabulary = lookup(vocabulary)
    words = F.split(tx.normalize_phrase(F.col(text)), " ")
    grams = rows.select(*keys, words.alias("_w"), longest_phrase(vocabulary).alias("_longest")).select(
        *keys, F.explode(_grams(F.col("_w"), F.col("_longest"))).alias("g")).select(*keys, "g.*")
    hits = grams.join(vocabulary, F.col("gram") == F.col("phrase"))
    kept = hits.groupBy(*keys, "kind").agg(accept_longest(F.collect_list(_match_struct())).alias("m"))
    return kept.select(*keys, "kind", F.explode(F.array_distinct(F.transform("m", lambda m: m["value"])))
                       .alias("value"))


def line_tags(lines: DataFrame, vocabulary: DataFrame, keys=("query_id", "line_no"),
              glyph_words: list[str] | None = None) -> DataFrame:
    """(keys, kind, value) attribute tags of label lines.

    Colours and sweetness are read from the look-alike-decoded text, grapes and
    producers from the text itself. Words of any spelling of a grape found in
    the line are not evidence of a colour.
    """
    vocabulary = keep(vocabulary)
    decoded = F.split(tx.decode_attribute_glyphs(F.col("text"), glyph_words), " ")
    plain = F.split(tx.normalize_phrase(F.col("text")), " ")
    forms = F.array(F.struct(F.lit("attr").alias("form"), decoded.alias("w")),
                    F.struct(F.lit("text").alias("form"), plain.alias("w")))
    grams = (lines.select(*keys, F.explode(forms).alias("f"), longest_phrase(vocabulary).alias("_longest"))
             .select(*keys, "f.form", F.explode(_grams(F.col("f.w"), F.col("_longest"))).alias("g"))
             .select(*keys, "form", "g.*"))
    masks = vocabulary.filter("kind = 'grapes'").withColumn("kind", F.lit("mask"))
    phrases = vocabulary.unionByName(masks).withColumn("gram", F.col("phrase")).withColumn(
        "form", F.when(F.col("kind").isin("color", "sweetness", "mask"), "attr").otherwise("text"))
    hits = grams.join(lookup(phrases), ["form", "gram"])
    per_line = hits.groupBy(*keys).agg(*[
        F.collect_list(F.when(F.col("kind") == kind, _match_struct())).alias(kind)
        for kind in [*ATTRIBUTES, "mask"]])
    masked = F.transform(accept_longest(F.col("mask")), lambda m: m["value"])
    spans = F.filter("mask", lambda m: F.array_contains("_masked", m["value"]))
    free = F.filter("color", lambda c: ~F.exists("_spans", lambda m: (
        (c["first"] < m["after"]) & (m["first"] < c["after"]))))
    per_line = per_line.withColumn("_masked", masked).withColumn("_spans", spans).withColumn("color", free)

    def named(kind):
        values = F.array_distinct(F.transform(accept_longest(F.col(kind)), lambda m: m["value"]))
        return F.transform(values, lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    tagged = F.flatten(F.array(*[named(kind) for kind in ATTRIBUTES]))
    return per_line.select(*keys, F.explode(tagged).alias("t")).select(*keys, "t.*")


def observed_profile(lines: DataFrame, vocabulary: DataFrame, floor: float = 0.8,
                     glyph_words: list[str] | None = None, evidence_per_value: int = 3) -> DataFrame:
    """(query_id, attribute): status, values and up to three evidence lines per value.

    All values count for ambiguity; only the evidence kept per value is limited.
    """
    usable = reliable_lines(lines, floor)
    tags = line_tags(usable, vocabulary, glyph_words=glyph_words)
    order = W.partitionBy("query_id", "kind", "value").orderBy("line_no")
    shown = (tags.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= evidence_per_value)
             .groupBy("query_id", "kind", "value").agg(F.array_sort(F.collect_list("line_no")).alias("lines")))
    values = shown.groupBy("query_id", "kind").agg(
        F.array_sort(F.collect_list(F.struct("value", "lines"))).alias("readings"))  # vocabulary-bounded
    asked = lines.select("query_id").distinct().select(
        "query_id", F.explode(tx.literal_array(ATTRIBUTES)).alias("kind"))
    rows = asked.join(values, ["query_id", "kind"], "left")
    n = F.size(F.coalesce("readings", F.array()))
    status = (F.when(n == 0, "missing").when((F.col("kind") == "grapes") | (n == 1), "read")
              .otherwise("ambiguous"))
    names = F.transform("readings", lambda r: r["value"])
    return rows.select(
        "query_id", F.col("kind").alias("attribute"), status.alias("status"),
        F.when((n > 0) & ((F.col("kind") == "grapes") | (n == 1)), names)
        .otherwise(F.array().cast("array<string>")).alias("values"), "readings")


def single_owner_aliases(names: DataFrame, name: str, excluded: DataFrame,
                         aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(value, phrase): spellings that point to one producer only.

    A producer is read by its name, its listed aliases, or a word of at least
    five letters that no other producer has and that is not excluded.
    """
    distinct = names.select(F.col(name).alias("value")).filter("value is not null and value <> ''").distinct()
    spellings = F.array("value")
    if aliases:
        known = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), tx.literal_array(v))])
        listed = F.coalesce(F.element_at(known, F.col("value")), F.array().cast("array<string>"))
        spellings = F.concat(spellings, listed)
    full = distinct.select("value", F.explode(spellings).alias("_p")).select(
        "value", tx.normalize_phrase(F.col("_p")).alias("phrase"))
    words = distinct.select("value", F.explode(F.array_distinct(F.split(
        tx.normalize_phrase(F.col("value")), " "))).alias("phrase")).filter(F.length("phrase") >= 5)
    words = words.join(excluded.select(F.col("word").alias("phrase")).distinct(), "phrase", "left_anti")
    lone = words.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")).filter("n = 1")
    every = full.unionByName(lone.select("value", "phrase")).distinct()
    owners = every.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    return owners.filter("n = 1 and phrase <> ''").select("value", "phrase")


def grape_values(cards: DataFrame, column: str, known: list[str],
                 composite: str = r"[()]| и ", context: str = "сорта винограда") -> DataFrame:
    """Distinct listed varieties that are no known spelling and no composite phrase."""
    parts = cards.select(F.explode(tx.split_list(F.col(column))).alias("value")).distinct()
    spelled = sorted({tx.py_normalize_phrase(k) for k in known})
    return parts.filter(~tx.normalize_phrase(F.col("value")).isin(spelled)
                        & ~F.contains("value", F.lit(context)) & ~F.col("value").rlike(composite))


def sequential_tags(lines: DataFrame, patterns=None, floor: float = 0.9) -> DataFrame:
    """(query_id, value, confidence): ordered patterns, each blanking what it matched."""
    usable = reliable_lines(lines, floor)
    found = tx.blank_patterns_in_order(F.col("text"), patterns or fv.SWEETNESS_PATTERNS)
    values = F.filter(F.array(*[F.when(hit, F.lit(value)) for value, hit in found]), lambda x: x.isNotNull())
    tags = usable.select("query_id", "confidence", F.explode(values).alias("value"))
    return tags.groupBy("query_id", "value").agg(F.max("confidence").alias("confidence"))


def single_reading(tags: DataFrame) -> DataFrame:
    """Per query: the value when there is exactly one, with its status."""
    return tags.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("_v"), F.max("confidence").alias("confidence")
    ).select("query_id", F.when(F.col("_n") == 1, F.col("_v")).alias("value"), "confidence",
             F.when(F.col("_n") == 1, "read").otherwise("ambiguous").alias("status"))


def observed_lines(lines: DataFrame, as_of_year: int, grapes=None, colors=None, floor: float = 0.65) -> DataFrame:
    """(query_id, field, value, text, confidence): the deduplicated label lines that show a value.

    Lines with the same collapsed lower-case text count once, with their best confidence.
    """
    key = F.regexp_replace(tx.fold_case(F.trim("text")), r"\s+", " ")
    usable = lines.filter(F.coalesce("on_target", F.lit(True)) & (F.col("confidence") >= floor))
    best = usable.withColumn("_key", key).filter("_key <> ''").groupBy("query_id", "_key").agg(
        F.max("confidence").alias("confidence"), F.min_by("text", F.struct(-F.col("confidence"), F.col("line_no")))
        .alias("text"))
    low = F.translate(tx.fold_case(F.col("text")), "ё", "е")

    def tags(field, patterns):
        return [F.when(low.rlike("(?U)" + p), F.struct(F.lit(field).alias("field"), F.lit(v).alias("value")))
                for v, p in patterns.items()]

    fixed = F.filter(F.array(*tags("grapes", grapes or fv.OBSERVED_GRAPE_PATTERNS),
                             *tags("colors", colors or fv.OBSERVED_COLOR_PATTERNS)), lambda t: t.isNotNull())
    years = F.transform(sc.year_candidates(F.col("text"), as_of_year),
                        lambda y: F.struct(F.lit("years").alias("field"), y.alias("value")))
    return best.select("query_id", "text", "confidence", F.explode(F.concat(fixed, years)).alias("t")).select(
        "query_id", "t.field", "t.value", "text", "confidence")


def observed_fields(lines: DataFrame, as_of_year: int, grapes=None, colors=None, floor: float = 0.65) -> DataFrame:
    """(query_id, field, value, lines, confidence): how many deduplicated label lines show a value, and how surely."""
    return observed_lines(lines, as_of_year, grapes, colors, floor).groupBy("query_id", "field", "value").agg(
        F.count(F.lit(1)).alias("lines"), F.max("confidence").alias("confidence"))
