"""Field-weighted fuzzy text retrieval of catalogue cards for label lines.

The catalogue becomes three tables (term weights per card text, vocabulary,
joined phrases); label words are matched once per distinct word; rare and heavy
terms meet the card texts in an equi-join and give each query its bar, common
terms only add to texts that can still reach it. Cards with the same text are
scored once and expanded at the end, so a group of copies costs one row.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catmatch import fixed_values as fv
from catmatch.functions import text as tx
from catmatch.operators.fuzzy import close_terms, joined_phrases, producer_edit_limit, term_keys, term_matches, variants_of
from catmatch.operators.ranking import top_k
from catmatch.sources.tables import keep, lookup, sent

#: Postings of a term that are taken or left as one.
TIER_ROWS = 256
#: Postings of a query that are read without a plan.
FEW_POSTINGS = 10_000
#: Readings of words that are sent to every task, at most.
MOST_READINGS = 400_000
#: Scores are rounded to so many places; sums of the same numbers in another order differ by less than _SLACK.
PLACES, _SLACK = 5, 1e-9

TEXTS = ["title", "winery", "grapes", "category", "region", "winery_alias", "slug_terms"]


@dataclass
class CatalogIndex:
    """Derived catalogue tables; persist them when many searches share a catalogue."""
    profiles: DataFrame    # profile, slugs' shared texts, facts
    members: DataFrame     # profile, slug
    weights: DataFrame     # profile, term, field, weight, idf and row flags
    vocabulary: DataFrame  # term, df, idf, owners, is_grape
    joined: DataFrame      # joined, parts
    keys: DataFrame        # key, term: by which near words find terms
    tiers: DataFrame       # term, tier, and of its postings: how many, the largest weights, the first slug


def with_text_fields(cards: DataFrame) -> DataFrame:
    """Cards with every searched text as a non-null column."""
    aliases = F.element_at(tx.literal_map({k: " ".join(v) for k, v in fv.WINERY_ALIASES.items()}), F.col("winery"))
    slug_words = F.regexp_replace(F.replace("slug", F.lit("-"), F.lit(" ")), r"\d+(?:-\d+)*", " ")
    ambiguous = F.col("exact_slug_ambiguity") if "exact_slug_ambiguity" in cards.columns else F.lit(False)
    plain = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "winery", "grapes", "category", "region")]
    return cards.select("slug", *plain, F.coalesce(aliases, F.lit("")).alias("winery_alias"),
                        slug_words.alias("slug_terms"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def best_fields(rows: DataFrame, key: str) -> DataFrame:
    """(key, term, field, field_weight): the highest-weighted field holding each term."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(fv.FIELD_WEIGHTS[f]).alias("field_weight"),
                                tx.tokens(f).alias("terms")) for f in TEXTS])
    spread = rows.select(key, F.explode(fields).alias("f")).select(
        key, "f.field", "f.field_weight", F.explode("f.terms").alias("term"))
    return spread.groupBy(key, "term").agg(F.max_by("field", "field_weight").alias("field"),
                                           F.max("field_weight").alias("field_weight"))


def idf(documents: Column, df: Column) -> Column:
    return F.least(F.lit(5.0), 1 + F.log((documents + 1) / (df + 1)))


def _tiered(weights: DataFrame, profiles: DataFrame, tier_rows: int) -> DataFrame:
    """Postings with a `tier`. Those of a term with more than `tier_rows` are parted by weight, in steps of an eighth of an
    e-fold, and by the place of the card's slug: its chunks hold the first tier_rows, 4, 16, 64 times as many, and the rest."""
    marks = [tier_rows * 4 ** k for k in range(4)]
    first = profiles.select("first_slug").orderBy("first_slug").limit(marks[-1]).toArrow().column(0).to_pylist()
    bounds = [first[m - 1] for m in marks if m <= len(first)]
    step = F.floor(8 * F.log(F.greatest(F.col("weight") + 2 * F.col("identity_weight"), F.lit(1e-9)))).cast("int")
    chunk = sum([(F.col("first_slug") > b).cast("int") for b in bounds], F.lit(0))
    return weights.withColumn("tier", F.when(F.col("postings") > tier_rows, (step + 1000) * 8 + chunk).otherwise(0)).drop("postings")


def build_index(cards: DataFrame, tier_rows: int = TIER_ROWS) -> CatalogIndex:
    texts = with_text_fields(cards)
    texts = keep(texts)
    key = F.sha2(F.to_json(F.struct(*TEXTS)), 256)
    members = texts.select(key.alias("profile"), "slug", "ambiguous")
    profiles = texts.groupBy(key.alias("profile")).agg(
        *[F.first(c).alias(c) for c in TEXTS], F.count(F.lit(1)).alias("copies"), F.min("slug").alias("first_slug"))
    total = cards.agg(F.count(F.lit(1))).scalar()
    title_size = F.greatest(F.size(F.array_distinct(tx.tokens("title"))), F.lit(1))
    mean = texts.agg(F.avg(title_size)).scalar()

    token_sets = profiles.select(
        "profile", "copies", "first_slug", *[F.array_distinct(tx.tokens(c)).alias(c) for c in TEXTS])
    special = tx.literal_array(fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS)
    winery = F.array_union("winery", "winery_alias")
    identity = F.filter(F.array_except(F.array_except("title", winery), special),
                        lambda t: ~t.rlike(r"^\p{N}+$") & (F.length(t) >= 3))
    sugars = F.array_intersect(F.array_union("title", "slug_terms"), tx.literal_array(fv.SWEETNESS_TERMS))
    facts = token_sets.select(
        "profile", "copies", "first_slug", winery.alias("winery_terms"), F.col("winery").alias("winery_name_terms"), identity.alias("identity"),
        F.col("category").alias("category_terms"), sugars.alias("sugars"), F.col("grapes").alias("grape_terms"),
        F.greatest(F.size("title"), F.lit(1)).alias("title_size"),
        F.size(identity).alias("n_identity"), (F.size("category") > 0).alias("has_category"),
        (F.size(sugars) > 0).alias("has_sugar"), (F.size("grapes") > 0).alias("has_grapes"),
        F.array(*[F.struct(F.lit(f).alias("field"), F.lit(fv.FIELD_WEIGHTS[f]).alias("field_weight"),
                           F.col(f).alias("terms")) for f in TEXTS]).alias("fields"))
    placed = facts.select("*", F.explode("fields").alias("f")).select(
        "*", "f.field", "f.field_weight", F.explode("f.terms").alias("term")).drop("fields", "f")
    flags = placed.groupBy("profile", "term").agg(
        F.max_by("field", "field_weight").alias("field"), F.max("field_weight").alias("field_weight"),
        *[F.max(c).alias(c) for c in ("copies", "first_slug", "title_size", "n_identity", "has_category", "has_sugar", "has_grapes")],
        F.bool_or(F.array_contains("winery_terms", F.col("term"))).alias("in_winery"),
        F.bool_or(F.array_contains("winery_name_terms", F.col("term"))).alias("in_winery_name"),
        F.bool_or(F.array_contains("identity", F.col("term"))).alias("in_identity"),
        F.bool_or(F.array_contains("category_terms", F.col("term"))).alias("in_category"),
        F.bool_or(F.array_contains("sugars", F.col("term"))).alias("in_sugar"),
        F.bool_or(F.array_contains("grape_terms", F.col("term"))).alias("in_grapes"))

    counts = flags.groupBy("term").agg(F.sum("copies").alias("df"), F.count(F.lit(1)).alias("postings"))
    owners = profiles.select("winery", F.explode(F.array_union(
        tx.tokens("winery"), tx.tokens("winery_alias"))).alias("term")).distinct().groupBy(
        "term").agg(F.count(F.lit(1)).alias("owners"))
    grapes = profiles.select(F.explode(tx.tokens("grapes")).alias("term")).distinct().filter(
        (F.length("term") >= 5) & ~F.col("term").isin(fv.COLOR_TERMS + fv.SWEETNESS_TERMS)).withColumn(
        "is_grape", F.lit(True))
    vocabulary = (counts.join(owners, "term", "left").join(grapes, "term", "left")
                  .withColumn("idf", idf(total, F.col("df")))
                  .fillna(0, ["owners"]).fillna(False, ["is_grape"]))
    vocabulary = keep(vocabulary)

    damped = F.when(F.col("field") == "title", F.col("field_weight") / (0.7 + 0.3 * F.col("title_size") / F.col("_mean"))
                    ).otherwise(F.col("field_weight"))
    technical = F.when(F.col("term").isin(fv.TECHNICAL_TERMS), 0.35).otherwise(1.0)
    digits = F.col("term").rlike(r"^\p{N}+$")
    minor = F.when(digits | ((F.length("term") == 2) & ~F.col("term").isin(fv.SHORT_IDENTIFIERS)), 0.2).otherwise(1.0)
    named = (F.col("field").isin("title", "winery", "grapes") & ~F.col("term").isin(
        fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS) & (
        (F.length("term") >= 3) | ((F.length("term") == 2) & ~digits & (F.col("df") <= 5))))
    weights = (flags.withColumn("_mean", mean).join(vocabulary.select("term", "idf", "df", "postings"), "term")
               .withColumn("weight", F.col("idf") * damped * technical * minor)
               .withColumn("names_it", named).withColumn("distinct_word", (
                   (F.length("term") >= 4) & ~digits
                   & ~F.col("term").isin(fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS))).drop("_mean", "df", "copies", "title_size")
               .withColumn("identity_weight", F.when(F.col("in_identity"), 1 / F.greatest("n_identity", F.lit(1))).otherwise(0.0)))
    weights = keep(_tiered(weights, profiles, tier_rows))
    tiers = keep(weights.groupBy("term", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"), F.max("identity_weight").alias("identity_weight"),
        F.min("first_slug").alias("first_slug")))
    return CatalogIndex(profiles, members, weights, vocabulary,
                        keep(joined_phrases(profiles, ["title", "winery", "grapes"], vocabulary)),
                        keep(term_keys(vocabulary.select("term"))), tiers)


def _usable(lines: DataFrame, floor: float) -> DataFrame:
    confidence = F.greatest(F.least(F.coalesce("confidence", F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    return lines.withColumn("confidence", confidence).filter(F.coalesce("on_target", F.lit(True)) & (F.col("confidence") >= floor))


def line_words(lines: DataFrame, floor: float = 0.2) -> DataFrame:
    """(query_id, confidence, raw, and line_no where lines have one): the distinct words of every line.

    The lines of a query meet in one task before they are cut into words: they are fewer and smaller than these.
    """
    number = [c for c in ("line_no",) if c in lines.columns]
    together = _usable(lines, floor).select("query_id", *number, "confidence", "text").repartition("query_id")
    return together.select("query_id", *number, "confidence", F.explode(F.array_distinct(tx.raw_words(F.col("text")))).alias("raw"))


def label_words(lines: DataFrame, floor: float = 0.2) -> DataFrame:
    """(query_id, raw, confidence): distinct words per query with their best confidence."""
    return line_words(lines, floor).groupBy("query_id", "raw").agg(F.max("confidence").alias("confidence"))


def best_evidence(words: DataFrame, matches: DataFrame) -> DataFrame:
    """(query_id, term, strength, ...): the strongest reading per query and term, with its `sources` where words have a line number."""
    sources = [F.array_sort(F.collect_set("line_no")).alias("sources")] if "line_no" in words.columns else []
    strength = F.col("match_strength") * (0.6 + 0.4 * F.col("confidence"))
    hits = words.join(matches, "raw").withColumn("strength", strength)
    rest = F.struct("strength", "confidence", "distance", "match_strength", "raw")
    best = F.max_by(rest, F.struct("strength", "confidence", -F.col("distance")))
    return hits.groupBy("query_id", "term").agg(best.alias("m"), *sources).select("query_id", "term", "m.*", *(["sources"] if sources else []))


@dataclass
class Reading:
    """What label lines say in the words of a catalogue."""
    words: DataFrame     # query_id, raw, confidence
    matches: DataFrame   # raw, term and how well it fits
    evidence: DataFrame  # query_id, term and the strongest reading of it


def read_lines(lines: DataFrame, index: CatalogIndex, sources: bool = False, floor: float = 0.2, once: bool = False) -> Reading:
    """With `sources` the evidence lists the numbers of the lines with a word that reads as its term.

    Evidence that is read `once` is not written: where the matches are sent it lies by query as it comes, so what follows in its query needs no shuffle.
    """
    asked = _usable(lines, floor).select(F.explode(F.array_distinct(tx.raw_words(F.col("text")))).alias("word")).distinct()
    matches = keep(term_matches(asked, index.vocabulary.select("term"), index.joined, keys=index.keys))
    words = label_words(lines, floor)
    known = sent(matches, MOST_READINGS) or matches
    evidence = best_evidence(line_words(lines, floor) if sources else words, known).drop("raw")
    return Reading(words, matches, evidence if once else keep(evidence))


def query_evidence(lines: DataFrame, index: CatalogIndex, once: bool = False) -> DataFrame:
    return read_lines(lines, index, once=once).evidence  # read by scores and evidence lists


def text_report(lines: DataFrame, reading: Reading, found: DataFrame) -> DataFrame:
    """Per query with lines: status (no_text_candidates where no card shares a term), the known terms and the words without any."""
    top = found.filter("rank = 1").select("query_id", "status")
    known = reading.evidence.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("known_terms"))
    readable = variants_of(reading.words.select(F.col("raw").alias("word")).distinct()).select("raw").distinct()
    strange = readable.join(reading.matches.select("raw"), "raw", "left_anti")
    unmatched = reading.words.join(strange, "raw").groupBy("query_id").agg(F.array_sort(F.collect_set("raw")).alias("unmatched_words"))
    none = F.array().cast("array<string>")
    return (lines.groupBy("query_id").agg(F.count(F.lit(1)).alias("observations"))
            .join(top, "query_id", "left").join(known, "query_id", "left").join(unmatched, "query_id", "left")
            .select("query_id", F.coalesce("status", F.lit("no_text_candidates")).alias("status"), "observations",
                    F.coalesce("known_terms", none).alias("known_terms"), F.coalesce("unmatched_words", none).alias("unmatched_words")))


def marked_terms(evidence: DataFrame, index: CatalogIndex) -> DataFrame:
    """The known terms of queries, with what they say about producer, colour, sugar and grapes."""
    facts = evidence.join(sent(index.vocabulary) or index.vocabulary, "term")
    s, known = F.col("strength"), fv.SHORT_IDENTIFIERS
    read = F.col("distance") == 0
    return facts.select(
        "query_id", "term", "strength", "postings", (F.col("idf") * s).alias("mass"),
        ((F.col("owners").between(1, 2)) & (s >= 0.83) & ((F.length("term") >= 4) | F.col("term").isin(known))).alias("is_producer"),
        (F.col("term").isin(fv.COLOR_TERMS) & read & (F.col("confidence") >= 0.65)).alias("is_color"),
        (F.col("term").isin(fv.SWEETNESS_TERMS) & read & (F.col("confidence") >= 0.65)).alias("is_sugar"),
        (F.col("is_grape") & read & (F.col("confidence") >= 0.9) & (F.col("match_strength") >= 0.96)).alias("is_grape"))


TOTALS = ("total_mass", "penalty", "n_color", "n_sugar", "n_grape")


def _totals() -> list[Column]:
    """What all terms of a query say together, in the order of TOTALS."""
    return [F.sum("mass"), F.max(F.when(F.col("is_producer"), F.col("mass") * 1.4)), F.count_if("is_color"), F.count_if("is_sugar"), F.count_if("is_grape")]


def _query_totals(marked: DataFrame) -> DataFrame:
    return marked.groupBy("query_id").agg(*[total.alias(n) for n, total in zip(TOTALS, _totals())])


def _with_totals(marked: DataFrame) -> DataFrame:
    """The same on every row, for terms that lie by query: they are made once and meet nothing."""
    own = W.partitionBy("query_id")  # a row per known term
    return marked.select("*", *[total.over(own).alias(n) for n, total in zip(TOTALS, _totals())])


def _scores(shared: DataFrame, queries: DataFrame | None) -> DataFrame:
    """Scores from all terms that queries share with card texts, one row each; without `queries` the rows tell the totals."""
    s = F.col("strength")
    reliable = F.col("field").isin("title", "grapes") & ~F.col("in_winery_name") & F.col("distinct_word")
    pairs = shared.groupBy("query_id", "profile").agg(
        F.sum(F.col("weight") * s * s).alias("base"), F.sum("mass").alias("matched"),
        F.sum(F.when(F.col("in_identity"), s).otherwise(0.0)).alias("identity_sum"),
        F.count_if("names_it").alias("identity_terms"),
        F.bool_or(F.col("is_producer") & F.col("in_winery")).alias("same_winery"),
        F.bool_or(F.col("is_color") & F.col("in_category")).alias("same_color"),
        F.bool_or(F.col("is_sugar") & F.col("in_sugar")).alias("same_sugar"),
        F.bool_or(F.col("is_grape") & F.col("in_grapes")).alias("same_grape"),
        F.max(F.when(reliable, s)).alias("identity_best"),
        F.bool_or(F.col("field").isin("winery", "winery_alias") & (s >= 0.7)).alias("producer_seen"),
        *[F.max(c).alias(c) for c in ("n_identity", "has_category", "has_sugar", "has_grapes")],
        *([F.max(c).alias(c) for c in TOTALS] if queries is None else []))
    rows = pairs if queries is None else pairs.join(queries, "query_id")
    off_winery = F.col("penalty").isNotNull() & ~F.col("same_winery")
    off = {"category": (F.col("n_color") == 1) & F.col("has_category") & ~F.col("same_color"),
           "sweetness": (F.col("n_sugar") == 1) & F.col("has_sugar") & ~F.col("same_sugar"),
           "grapes": (F.col("n_grape") == 1) & F.col("has_grapes") & ~F.col("same_grape")}
    identity = F.col("identity_sum") / F.greatest(F.col("n_identity"), F.lit(1))
    score = F.col("base") - F.when(off_winery, F.col("penalty")).otherwise(0.0) + 2 * identity
    for flag in off.values():
        score = score - F.when(flag, 3.0).otherwise(0.0)
    conflicts = F.filter(F.array(F.when(off_winery, "winery"), *[F.when(f, n) for n, f in off.items()]),
                         lambda c: c.isNotNull())
    return rows.select(
        "query_id", "profile", F.round(score, PLACES).alias("score"),
        (F.col("matched") / F.greatest("total_mass", F.lit(1e-9))).alias("query_term_coverage"),
        identity.alias("title_identity_coverage"), conflicts.alias("conflicts"), "identity_terms",
        (F.coalesce("identity_best", F.lit(0.0)) * F.when(F.col("producer_seen"), 1.0).otherwise(0.35))
        .alias("reliability"))


def score_profiles(evidence: DataFrame, index: CatalogIndex, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, profile, score, coverages, conflicts): every card text sharing a term.

    The terms of a query lie in one task: where the postings (`weights`, if known to be few) are sent, its card texts are scored there.
    """
    weights = weights or sent(index.weights)
    marked = marked_terms(evidence, index)
    if weights is None:
        return _scores(marked.join(index.weights, "term"), _query_totals(marked))
    return _scores(_with_totals(marked).join(weights, "term"), None)


def best_profiles(evidence: DataFrame, index: CatalogIndex, limit: int, few: int | None = None) -> DataFrame:
    """The rows of score_profiles that can be among the best `limit` of their query by score and first slug.

    Of a catalogue that can be sent to every task all card texts are scored, unless `few` is given. Else a query whose terms have no more than `few` postings together is scored whole at once: to plan costs
    more than to read them. For the others a term gives a card text at most its bound: the largest weights of the text's tier of postings;
    conflicts only take away. The tiers of the largest bounds give a query its bar, the score of its
    limit-th best card text so far. Tiers are then added up from the smallest bounds: as long as their sum, with one
    tier a term, stays below the bar, a card text in these alone cannot get there, so their postings are not read.
    What the other tiers touch is scored whole if it can reach the bar with all that was left out.
    """
    weights = sent(index.weights) if few is None else None
    if weights is not None:
        return score_profiles(evidence, index, weights)
    few = FEW_POSTINGS if few is None else few
    everything = keep(marked_terms(evidence, index))
    sizes = everything.groupBy("query_id").agg((F.sum("postings") <= few).alias("_few"))
    sized = everything.join(sizes, "query_id")
    short = sized.filter("_few").drop("_few")
    at_once = _scores(short.join(index.weights, "term"), _query_totals(short))
    marked = keep(sized.filter("not _few").drop("_few"))
    if marked.isEmpty():
        return at_once
    queries = _query_totals(marked)
    s = F.col("strength")
    bound = lambda t: t("weight") * s * s + 2 * s * t("identity_weight")
    tier = index.tiers.select("term", "tier", "n", "weight", "identity_weight", F.col("first_slug").alias("tier_slug"))
    plan = keep(marked.select("query_id", "term", "strength").join(tier, "term").select(
        "query_id", "term", "tier", "n", "strength", "tier_slug", bound(F.col).alias("bound")))
    postings = index.weights.select("term", "tier", "profile", "first_slug", "weight", "identity_weight")
    touch = lambda some: some.join(postings, ["term", "tier"]).groupBy("query_id", "profile").agg(
        F.sum(bound(F.col)).alias("seen"), F.max("first_slug").alias("first_slug"))

    def whole(pairs: DataFrame) -> DataFrame:
        shared = pairs.select("query_id", "profile").join(index.weights, "profile").join(marked, ["query_id", "term"])
        return _scores(shared, queries)

    best_first = W.partitionBy("query_id").orderBy(F.col("bound").desc(), F.col("tier_slug"), F.col("term"))
    before = F.sum("n").over(best_first) - F.col("n")
    probes = touch(plan.withColumn("_before", before).filter(F.col("_before") < 4 * limit))
    probes = top_k(probes, ["query_id"], [F.col("seen").desc(), F.col("first_slug")], 2 * limit, "_n")
    order = [F.col("score").desc(), F.col("first_slug")]
    bars = top_k(whole(probes).join(index.profiles.select("profile", "first_slug"), "profile"), ["query_id"], order, limit, "_n").filter(F.col("_n") == limit).select(
        "query_id", F.col("score").alias("bar"), F.col("first_slug").alias("bar_slug"))

    own = W.partitionBy("query_id", "term").orderBy("bound", F.col("tier_slug").desc())
    least_first = W.partitionBy("query_id").orderBy("bound", F.col("tier_slug").desc(), "term")
    fine = F.floor(F.col("bound") / _SLACK)
    close = W.partitionBy("query_id", "term").orderBy(fine).rangeBetween(-int(2 * 10.0 ** -PLACES / _SLACK), -1)
    steps = (plan.join(bars, "query_id", "left")
             .withColumn("_more", F.col("bound") - F.coalesce(F.lag("bound").over(own), F.lit(0.0)))
             .withColumn("_sum", F.sum("_more").over(least_first)).withColumn("_close", F.count(F.lit(1)).over(close)))
    reach = F.round(F.col("_sum") + _SLACK, PLACES)
    # Who just reaches the bar is in the last tier added, or in one of the same bound before it: later by slug.
    tied = (reach == F.col("bar")) & (F.col("_close") == 0) & (F.col("tier_slug") > F.col("bar_slug"))
    steps = keep(steps.withColumn("left_out", F.coalesce((reach < F.col("bar")) | tied, F.lit(False))))
    rest = steps.groupBy("query_id").agg(F.max(F.when(F.col("left_out"), F.col("_sum"))).alias("rest"), F.first("bar").alias("bar"))
    touched = touch(steps.filter("not left_out")).join(rest, "query_id")
    most = F.round(F.col("seen") + F.coalesce("rest", F.lit(0.0)) + _SLACK, PLACES)
    able = touched.filter(F.col("bar").isNull() | (most >= F.col("bar")))
    # The best so far are among them, or lie below the bar with the tiers that were left out.
    most_able = able.select("query_id", "profile").unionByName(probes.select("query_id", "profile")).distinct()
    return at_once.unionByName(whole(most_able))


def expand_members(scored: DataFrame, index: CatalogIndex, limit: int) -> DataFrame:
    """Best `limit` cards per query from scored card texts, by score and slug.

    A card among the best has its text among the best `limit` texts (by score
    and first slug) and its slug among the first `limit` of that text.
    """
    firsts = lookup(index.profiles.select("profile", "first_slug"))
    best = top_k(scored.join(firsts, "profile"), ["query_id"],
                 [F.col("score").desc(), F.col("first_slug")], limit, "_n").drop("_n", "first_slug")
    slugs = lookup(top_k(index.members, ["profile"], [F.col("slug")], limit, "_n").drop("_n"))
    return top_k(best.join(slugs, "profile"), ["query_id"], [F.col("score").desc(), F.col("slug")], limit)


def text_search(lines: DataFrame, cards: DataFrame, limit: int = 10, index: CatalogIndex | None = None,
                evidence: DataFrame | None = None) -> DataFrame:
    """Ranked cards per query with score, coverages, conflicts, margin and match status."""
    if limit < 1:
        raise ValueError("limit must be positive")
    index = index or build_index(cards)
    evidence = evidence if evidence is not None else query_evidence(lines, index, once=True)
    ranked = expand_members(best_profiles(evidence, index, max(limit, 2)), index, max(limit, 2))
    shortlist = W.partitionBy("query_id").orderBy("rank")  # at most max(limit, 2) rows
    whole = shortlist.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, second = F.first("score").over(whole), F.nth_value("score", 2).over(whole)
    margin = F.when(second.isNull(), 1.0).otherwise((first - second) / F.greatest(F.abs(first), F.lit(1.0)))
    top = lambda c: F.first(c).over(whole)
    sure = ((first > 0) & (margin >= 0.15) & (F.round(top("query_term_coverage"), 4) >= 0.55) & (top("identity_terms") >= 2)
            & (F.size(top("conflicts")) == 0) & ~top("ambiguous"))
    return (ranked.withColumn("relative_top_margin", margin)
            .withColumn("status", F.when(sure, "tentative_match").otherwise("needs_review"))
            .filter(F.col("rank") <= limit)
            .select("query_id", "rank", "slug", "profile", "score", "query_term_coverage", "title_identity_coverage",
                    "conflicts", "identity_terms", "relative_top_margin", "status"))


def attach_evidence(candidates: DataFrame, evidence: DataFrame, index: CatalogIndex) -> DataFrame:
    """One row per (candidate, shared term) of already cut shortlists, with its contribution and what else the evidence tells."""
    asked = candidates.select("query_id", "slug", "profile")
    postings = index.weights.select("profile", "term", "field", "weight")
    few = sent(postings)
    if few is None:
        rows = asked.join(postings, "profile").join(evidence, ["query_id", "term"])
    else:  # a query's terms and cards meet in its task
        rows = asked.join(evidence.repartition("query_id"), "query_id").join(few, ["profile", "term"])
    return rows.withColumn("contribution", F.col("weight") * F.col("strength") * F.col("strength")).drop("profile", "weight")


def missing_terms(candidates: DataFrame, evidence: DataFrame, index: CatalogIndex, n: int = 12) -> DataFrame:
    """The n heaviest query terms a shortlisted card does not have.

    A card has no more of a query's terms than it has terms: so many and n more of the heaviest hold all that it can lack.
    """
    vocabulary, postings = (sent(t) or t for t in (index.vocabulary.select("term", "idf"), index.weights.select("profile", "term")))
    terms = evidence.repartition("query_id").join(vocabulary, "term").select(
        "query_id", "term", (F.col("idf") * F.col("strength")).alias("mass"))
    most = index.weights.groupBy("profile").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    terms = top_k(terms, ["query_id"], [F.col("mass").desc(), F.col("term")], n + most, "_n").drop("_n")
    rows = candidates.select("query_id", "slug", "profile").join(terms, "query_id")
    absent = rows.join(postings, ["profile", "term"], "left_anti")
    return top_k(absent.drop("profile"), ["query_id", "slug"], [F.col("mass").desc(), F.col("term")], n)


def producer_terms(cards: DataFrame) -> DataFrame:
    """(term, winery): distinctive producer words and word pairs with a single owner."""
    special = fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS + fv.GENERIC_PRODUCER_TERMS
    incidental = cards.select(F.explode(F.concat(tx.tokens("grapes"), tx.tokens("region"))).alias("term")).distinct()
    names = cards.select(F.coalesce("winery", F.lit("")).alias("winery")).distinct()
    listed = F.element_at(F.create_map(*[x for k, v in fv.PRODUCER_SEARCH_ALIASES.items()
                                         for x in (F.lit(k), tx.literal_array(v))]), F.col("winery"))
    spelled = names.select("winery", F.explode(F.concat(F.array("winery"), F.coalesce(
        listed, F.array().cast("array<string>")))).alias("name"))
    words = spelled.select("winery", tx.tokens("name").alias("w"))
    single = words.select("winery", F.explode("w").alias("term"))
    duos = words.filter(F.size("w") >= 2).select("winery", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.slice("w", i, 2))).alias("duo"))
    duos = duos.select("winery", F.col("duo")[0].alias("a"), F.col("duo")[1].alias("b")).filter(
        (F.length("a") >= 3) & (F.length("b") >= 3) & ~F.col("a").isin(special) & ~F.col("b").isin(special))
    for side in ("a", "b"):
        duos = duos.join(incidental.select(F.col("term").alias(side)), side, "left_anti")
    terms = single.unionByName(duos.select("winery", F.concat("a", "b").alias("term")))
    terms = terms.filter(~F.col("term").isin(special) & ((F.length("term") >= 4) | (F.col("term") == "kd")))
    terms = terms.join(incidental, "term", "left_anti").distinct()
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("winery").alias("winery")).filter(
        "n = 1").select("term", "winery")


def producer_matches(words: DataFrame, owners: DataFrame, floor: float = 0.8, margin: float = 0.08) -> DataFrame:
    """(raw, winery, term, similarity): a word names a producer if no other is as close."""
    readings, owners = keep(variants_of(words)), keep(owners)  # both are read several times
    near = close_terms(readings.select("word").distinct(), owners.select("term"), producer_edit_limit)
    longest = F.greatest(F.length("word"), F.length("term"))
    hits = readings.join(near, "word").withColumn(
        "similarity", (1 - F.col("distance") / longest) * F.col("prior")).filter(F.col("similarity") >= floor)
    owned = hits.join(owners, "term").groupBy("raw", "winery").agg(
        F.max("similarity").alias("similarity"),
        F.max_by("term", F.struct("similarity", "term")).alias("term"))
    best = top_k(owned, ["raw"], [F.col("similarity").desc(), F.col("winery")], 2, "_n")
    alone = best.groupBy("raw").agg(
        F.min_by(F.struct("winery", "term", "similarity"), "_n").alias("m"),
        F.max(F.when(F.col("_n") == 2, F.col("similarity"))).alias("_second"))
    return alone.filter(F.col("_second").isNull() | (F.col("m.similarity") - F.col("_second") >= margin)).select("raw", "m.*")


def producer_search(lines: DataFrame, cards: DataFrame, floor: float = 0.85, margin: float = 0.08) -> DataFrame:
    """Per query with lines: recognised, ambiguous or unreadable producer."""
    confidence = F.coalesce("confidence", F.lit(1.0))
    usable = lines.filter(F.coalesce("on_target", F.lit(True)) & confidence.between(floor, 1.0))
    words = usable.select("query_id", confidence.alias("confidence"),
                          F.explode(tx.raw_words(F.col("text"))).alias("raw")).groupBy("query_id", "raw").agg(
        F.max("confidence").alias("confidence"))
    words = keep(words)
    matches = producer_matches(words.select(F.col("raw").alias("word")).distinct(), producer_terms(cards))
    votes = words.join(matches, "raw").groupBy("query_id", "winery").agg(
        F.max(F.col("similarity") * F.col("confidence")).alias("strength"))
    verdict = producer_vote(votes, margin)
    return lines.select("query_id").distinct().join(verdict, "query_id", "left").select(
        "query_id", F.coalesce("status", F.lit("unreadable")).alias("status"), "winery", "strength")


def producer_vote(votes: DataFrame, margin: float = 0.08) -> DataFrame:
    best = top_k(votes, ["query_id"], [F.col("strength").desc(), F.col("winery")], 2)
    two = best.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("winery"))).alias("_w"),
        F.max(F.when(F.col("rank") == 1, F.col("strength"))).alias("strength"),
        F.max(F.when(F.col("rank") == 2, F.col("strength"))).alias("_second"))
    clear = F.col("_second").isNull() | (F.col("strength") - F.col("_second") >= margin)
    return two.select("query_id", F.when(clear, "recognized").otherwise("ambiguous").alias("status"),
                      F.when(clear, F.col("_w")).alias("winery"), "strength")


def text_reliability(evidence: DataFrame, wineries: DataFrame) -> DataFrame:
    """(query_id, slug, reliability): strongest identity term, damped when no producer was seen.

    `evidence` has (query_id, slug, term, field, strength); `wineries` the
    winery words per slug.
    """
    special = fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS
    rows = evidence.join(wineries.select("slug", "winery_terms"), "slug")
    identity = (F.col("field").isin("title", "grapes") & ~F.array_contains("winery_terms", F.col("term"))
                & ~F.col("term").isin(special) & (F.length("term") >= 4) & ~F.col("term").rlike(r"^\p{N}+$"))
    seen = F.col("field").isin("winery", "winery_alias") & (F.col("strength") >= 0.7)
    return rows.groupBy("query_id", "slug").agg(
        F.max(F.when(identity, F.col("strength"))).alias("_best"), F.bool_or(seen).alias("_seen")).select(
        "query_id", "slug", F.coalesce(F.col("_best") * F.when(F.col("_seen"), 1.0).otherwise(0.35), F.lit(0.0))
        .alias("reliability"))
