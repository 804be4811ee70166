"""Decisions on a shortlist: near ties, membership features, scores, refusal, confirmation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catmatch import fixed_values as fv
from catmatch.functions import scalars as sc, text as tx
from catmatch.sources.tables import keep


def title_terms(title: str = "title", winery: str = "winery") -> Column:
    """Distinct title words that are not of the winery, a colour or a sweetness."""
    own = F.array_distinct(tx.tokens(title))
    other = F.array_union(tx.tokens(winery),
                          tx.literal_array(fv.COLOR_TERMS + fv.SWEETNESS_TERMS))
    return F.array_except(own, other)


def distinctive_terms(owned: DataFrame, owner: str, term: str) -> DataFrame:
    """Terms that a single owner has."""
    pairs = owned.select(owner, term).distinct()
    unique = pairs.groupBy(term).agg(F.count(F.lit(1)).alias("_n"), F.min(owner).alias(owner))
    return unique.filter("_n = 1").select(owner, term)


def family_key(columns=("title", "winery", "grapes", "category")) -> Column:
    """Equal for variants of one line; null when a field is empty."""
    parts = [F.trim(F.regexp_replace(F.translate(tx.fold_case(F.coalesce(F.col(c), F.lit(""))), "ё", "е"),
                                     r"\s+", " ")) for c in columns]
    complete = parts[0] != ""
    for part in parts[1:]:
        complete = complete & (part != "")
    return F.when(complete, F.struct(*[p.alias(c) for p, c in zip(parts, columns)]))


def visible(candidates: DataFrame, alternatives: Column, rank: str = "rank") -> DataFrame:
    """Five ranked rows, or only the first where alternatives are off; ranks do not change."""
    return candidates.filter(F.col(rank) <= F.when(alternatives, 5).otherwise(1))


def result_gate(jobs: DataFrame, candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """Choices that name a visible candidate of a finished, not refused scan."""
    ready = jobs.filter((F.col("status") == "done")
                        & ~F.coalesce("recognition_status", F.lit("")).isin("not_in_catalog", "no_target"))
    shown = visible(candidates.join(ready.select("query_id", "alternatives"), "query_id"),
                    F.col("alternatives"))
    return choices.join(shown.select("query_id", "slug"), ["query_id", "slug"], "left_semi")


def confirm(jobs: DataFrame, candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """Shortlists with an accepted user choice marked; scores stay as they were."""
    accepted = result_gate(jobs, candidates, choices).select("query_id", "slug", F.lit(True).alias("_c"))
    return (candidates.join(accepted, ["query_id", "slug"], "left")
            .withColumn("confirmed_by_user", F.coalesce("_c", F.lit(False))).drop("_c"))


def refine_near_ties(candidates: DataFrame, observed: DataFrame, cards: DataFrame,
                     bonus: float = fv.SWEETNESS_BONUS, max_gap: float = fv.SWEETNESS_MAX_GAP) -> DataFrame:
    """Prefer the variant whose reviewed value the label names, among near-tied relatives.

    `candidates` are shortlists (query_id, slug, rank, score), `observed` has one
    value and confidence per query, `cards` a family key and a reviewed value.
    """
    info = cards.select("slug", "family", "reviewed")
    rows = candidates.join(info, "slug", "left").join(
        observed.select("query_id", F.col("value").alias("_value"), F.col("confidence").alias("_conf")),
        "query_id", "left")
    leader = F.col("rank") == 1
    relative = F.col("family").isNotNull() & (F.col("family") == F.col("_family")) & (F.col("rank") <= 5)
    gap = F.col("_first") - F.col("score")
    match = relative & (F.col("reviewed") == F.col("_value")) & gap.between(0, max_gap)
    first = rows.filter(leader).select("query_id", F.col("family").alias("_family"),
                                       F.col("score").alias("_first"))
    joined = rows.join(first, "query_id", "left").withColumn("_match", F.coalesce(match, F.lit(False)))
    support = joined.groupBy("query_id").agg(
        F.size(F.collect_set(F.when(relative, F.col("reviewed")))).alias("_values"),
        F.bool_or("_match").alias("_any"))
    applied = (F.col("_values") >= 2) & F.col("_any")
    scored = joined.join(support, "query_id").withColumn("applied", applied).withColumn(
        "bonus", F.when(applied & F.col("_match"), bonus * F.col("_conf")).otherwise(0.0))
    order = W.partitionBy("query_id").orderBy(
        F.when(F.col("applied"), F.col("new_score")).desc_nulls_last(),
        F.when(F.col("applied"), F.col("slug")).asc_nulls_last(), F.col("rank"))  # one shortlist
    ranked = scored.withColumn("new_score", F.col("score") + F.col("bonus")).withColumn(
        "new_rank", F.row_number().over(order).cast("bigint"))
    return ranked.select(*candidates.columns, "bonus", "new_score", "new_rank", "applied")


def coverage(evidence: DataFrame, terms: DataFrame, out: str) -> DataFrame:
    """Mean best strength over the terms of each (query, slug); a term unseen counts zero.

    `terms` has query_id, slug and an array column `terms`.
    """
    best = evidence.groupBy("query_id", "slug", "term").agg(F.max("strength").alias("_s"))
    wanted = terms.select("query_id", "slug", F.explode("terms").alias("term"))
    sums = wanted.join(best, ["query_id", "slug", "term"]).groupBy("query_id", "slug").agg(
        F.sum("_s").alias("_sum"))
    n = F.greatest(F.size("terms"), F.lit(1))
    return terms.join(sums, ["query_id", "slug"], "left").select(
        "query_id", "slug", (F.coalesce("_sum", F.lit(0.0)) / n).alias(out))


def card_evidence(evidence: DataFrame) -> DataFrame:
    """(query_id, slug, seen, producer, bad): what each card of a shortlist was found by, in one row."""
    strength = sc.evidence_strength(F.col("confidence"), F.col("match_strength"))
    # A card's evidence is dealt once, for its terms and for the card.
    dealt = evidence.withColumn("strength", strength).repartition("query_id", "slug")
    best = dealt.groupBy("query_id", "slug", "term").agg(
        F.max("strength").alias("s"),
        F.max(F.when(F.col("field").isin("winery", "winery_alias"), F.col("strength"))).alias("w"),
        F.count_if(F.col("strength").isNull()).alias("bad"))
    return best.groupBy("query_id", "slug").agg(
        F.collect_list(F.struct("term", F.coalesce("s", F.lit(0.0)).alias("s"))).alias("seen"),  # terms of one card
        F.max("w").alias("producer"), F.sum("bad").alias("bad"))


def membership_features(candidates: DataFrame, evidence: DataFrame, cards: DataFrame,
                        ocr: DataFrame) -> DataFrame:
    """The 18 presence features of every complete five-candidate shortlist, one row per query.

    `evidence` may be rows of terms or their card_evidence. Shortlists hold five rows, so the whole query fits one array: the features
    are expressions over that array and cost a single shuffle by query.
    """
    product = F.col("product") if "product" in cards.columns else sc.product_key(
        F.col("slug"), F.col("winery"), F.col("grapes"), F.col("category"))
    fields = cards.select(
        "slug", "winery", title_terms().alias("title_terms"),
        F.array_distinct(tx.tokens("grapes")).alias("grape_terms"),
        product.alias("product"))
    grouped = evidence if "seen" in evidence.columns else card_evidence(evidence)
    rows = candidates.filter("rank <= 5").join(fields, "slug", "left").join(
        grouped, ["query_id", "slug"], "left")
    one = F.struct(
        "rank", "slug", "score", F.coalesce("visual_similarity", F.lit(0.0)).alias("visual"),
        F.greatest(F.coalesce("text_score", F.lit(0.0)), F.lit(0.0)).alias("text"), "conflicts",
        F.coalesce("producer_match", F.lit(False)).alias("producer_match"), "winery", "title_terms",
        "grape_terms", "product", F.coalesce("producer", F.lit(0.0)).alias("producer"),
        F.coalesce("bad", F.lit(0)).alias("bad"),
        F.coalesce("seen", F.array().cast("array<struct<term:string,s:double>>")).alias("seen"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("c"))

    def cover(row, terms):
        total = F.aggregate(row["seen"], F.lit(0.0), lambda acc, e: acc + F.when(
            F.array_contains(terms, e["term"]), e["s"]).otherwise(0.0))
        return total / F.greatest(F.size(terms), F.lit(1))

    def highest(values):
        return F.array_max(values)

    c, first = F.col("c"), F.col("c")[0]
    lists = lists.withColumn("others", F.filter(c, lambda x: x["product"] != first["product"])).withColumn(
        "supports", F.transform(c, lambda x: cover(x, x["title_terms"])))
    other_terms = F.flatten(F.transform("others", lambda x: x["title_terms"]))
    lists = lists.withColumn("distinct_terms", F.array_except(first["title_terms"], other_terms))
    pick = lambda field: F.transform(c, lambda x: x[field])
    other = lambda field: F.coalesce(highest(F.transform("others", lambda x: x[field])), first[field])
    leader = lambda field: F.filter(c, lambda x: x[field] == highest(pick(field)))[0]["product"]
    mismatch = F.array_contains(first["conflicts"], "winery") | F.exists(
        c, lambda x: x["producer_match"] & ~x["winery"].eqNullSafe(first["winery"]))
    top_text = highest(pick("text"))
    values = [
        first["visual"], highest(pick("visual")), first["visual"] - other("visual"), first["producer"],
        F.col("supports")[0], cover(first, F.col("distinct_terms")), F.size("distinct_terms") > 0,
        cover(first, first["grape_terms"]),
        (first["text"] - other("text")) / F.greatest(top_text, F.lit(1.0)), mismatch,
        F.array_contains(first["conflicts"], "grapes"), F.array_contains(first["conflicts"], "category"),
        F.array_contains(first["conflicts"], "sweetness"), highest(F.col("supports")),
        highest(pick("producer")), (top_text > 0) & (leader("visual") == leader("text")),
        F.coalesce("ocr_available", F.lit(False)), F.size(first["title_terms"]) > 0]
    complete = (F.size(c) == 5) & (F.size(F.array_distinct(pick("slug"))) == 5)
    clean = ~F.exists(c, lambda x: x["bad"] > 0) & F.forall(
        c, lambda x: sc.is_finite(x["visual"]) & sc.is_finite(x["text"]) & x["product"].isNotNull())
    protected = F.exists(F.arrays_zip(c, "supports"), lambda z: (
        (z["c"]["producer"] >= 0.8) & (z["supports"] >= 0.8)))
    joined = lists.join(ocr.select("query_id", "ocr_available"), "query_id", "left")
    return joined.select(
        "query_id", complete.alias("complete"), clean.alias("valid"), protected.alias("protected"),
        *[value.cast("double").alias(name) for name, value in zip(fv.MEMBERSHIP_FEATURES, values)])


def linear_score(columns: list[Column], model: dict) -> Column:
    """Standardised features times coefficients plus intercept, as plain column arithmetic."""
    total = F.lit(float(model["intercept"]))
    for column, mean, scale, weight in zip(columns, model["mean"], model["scale"], model["coefficients"]):
        total = total + (column - mean) / scale * weight
    return total


def check_model(model: dict, features: int, monotone_first: bool = False) -> dict:
    """Reject a model whose vectors do not fit the features or are not finite."""
    vectors = [model["mean"], model["scale"], model["coefficients"]]
    finite = all(abs(x) < float("inf") for v in vectors for x in v)  # NaN compares false
    if any(len(v) != features for v in vectors) or not finite or min(model["scale"]) <= 0:
        raise ValueError("invalid model vectors")
    if monotone_first and model["coefficients"][0] < 0:
        raise ValueError("score must not fall with the retrieval gap")
    return model


def refuse_unknown(features: DataFrame, model: dict, no_target: Column | None = None) -> DataFrame:
    """Refusal decision per query: only complete, valid, unprotected evidence can reject."""
    check_model(model, len(fv.MEMBERSHIP_FEATURES))
    target = F.lit(False) if no_target is None else F.coalesce(no_target, F.lit(False))
    logit = linear_score([F.col(f) for f in fv.MEMBERSHIP_FEATURES], model)
    score = sc.logistic(logit)
    usable = F.col("complete") & ~target & F.col("valid") & sc.is_finite(logit)
    reason = (F.when(~F.col("complete"), "complete_top5_required").when(target, "no_target")
              .when(~usable, "invalid_evidence_keep_candidates")
              .when(F.col("ocr_available") == 0, "no_reliable_ocr")
              .when(F.col("protected"), "positive_identity_evidence")
              .when(score < model["reject_below"], "below_conservative_presence_threshold")
              .otherwise("keep_candidates"))
    return features.select(
        "query_id", F.when(usable, score).alias("presence_score"), reason.alias("reason"),
        (reason == "below_conservative_presence_threshold").alias("reject"))


def score_candidates(candidates: DataFrame, features: DataFrame, model: dict,
                     decision: DataFrame) -> DataFrame:
    """Match score of the first five; null where the evidence is incomplete or invalid."""
    check_model(model, len(fv.MEMBERSHIP_FEATURES) + 2, monotone_first=True)
    context = features.select("query_id", "complete", "valid", *fv.MEMBERSHIP_FEATURES).join(
        decision.select("query_id", "reject"), "query_id", "left")
    best = candidates.filter("rank <= 5").groupBy("query_id").agg(
        F.max("score").alias("_best"), F.bool_and(sc.is_finite(F.col("score"))).alias("_finite"))
    rows = candidates.join(context.join(best, "query_id"), "query_id", "left")
    inputs = [F.col("score") - F.col("_best"), *[F.col(f) for f in fv.MEMBERSHIP_FEATURES], F.col("_best")]
    raw = 1 / (1 + F.exp(-sc.clip(linear_score(inputs, model), -700, 700)))
    capped = F.when(F.coalesce("reject", F.lit(False)), F.least(raw, F.lit(float(model["refusal_cap"])))).otherwise(raw)
    scored = F.col("complete") & F.col("valid") & F.col("_finite")
    return rows.select(
        *candidates.columns, F.when(scored & (F.col("rank") <= 5), capped).alias("scored_match"),
        F.when(F.coalesce(scored, F.lit(False)), "scored").otherwise("unavailable").alias("scoring_status"))


def finalize(candidates: DataFrame, observed: DataFrame, cards: DataFrame, features: DataFrame,
             refusal_model: dict, scoring_model: dict, alternatives: Column) -> DataFrame:
    """Refusal on the original order, tie refinement unless rejected, scores, then the cut.

    `features` is a function of a shortlist: the refusal reads those of the
    original order, the scores those of the refined one.
    """
    decision = keep(refuse_unknown(features(candidates), refusal_model))
    rejected = decision.filter("reject").select("query_id")
    kept = observed.join(rejected, "query_id", "left_anti")
    refined = refine_near_ties(candidates, kept, cards).withColumn("rank", F.col("new_rank")).withColumn(
        "score", F.col("new_score"))
    refined = keep(refined.select(*candidates.columns, "applied"))
    scored = score_candidates(refined, features(refined), scoring_model, decision)
    shown = visible(scored.join(decision.select("query_id", "reject", "reason"), "query_id"), alternatives)
    status = F.when(F.col("reject"), "not_in_catalog").otherwise("candidates_unverified")
    lists = shown.groupBy("query_id").agg(
        F.min_by("slug", "rank").alias("_first"), F.min_by("scored_match", "rank").alias("_score"),
        F.count(F.lit(1)).alias("_n"), F.bool_or("applied").alias("refined"),
        F.max("reject").alias("reject"), F.max("reason").alias("reason"))
    return lists.select(
        "query_id", F.when(F.col("reject"), "unknown").otherwise(F.col("_first")).alias("slug"),
        status.alias("recognition_status"), "reason", "refined",
        F.when(~F.col("reject"), F.col("_score")).alias("match_score"),
        F.when(F.col("reject"), F.lit(0)).otherwise(F.col("_n")).cast("bigint").alias("shown"))


def history_snapshot(shortlists: DataFrame, results: DataFrame, default_confidence: float = 0.0) -> DataFrame:
    """What a scan is saved as: the user's choice, a confident first, or unverified.

    `results` has query_id, recognition_status and confirmed_slug; refused scans
    are saved as absent with confidence 0, scans without a target are dropped.
    """
    kept = results.filter(~F.coalesce("recognition_status", F.lit("")).eqNullSafe("no_target"))
    rows = shortlists.join(kept, "query_id")
    chosen = F.coalesce(F.col("slug") == F.col("confirmed_slug"), F.lit(False))
    picked = rows.groupBy("query_id").agg(
        F.max("recognition_status").alias("_status"),
        F.min(F.when(chosen, F.struct("rank", "slug", "match_score"))).alias("_user"),
        F.min(F.struct("rank", "slug", "match_score")).alias("_first"))
    score = F.col("_first.match_score")
    strong = (F.col("_first.rank") == 1) & sc.is_finite(score) & (score > 0.5) & (score <= 1)
    absent = F.col("_status") == "not_in_catalog"
    by_user = F.col("_user").isNotNull()
    status = (F.when(absent, "not_in_catalog").when(by_user, "user_confirmed")
              .when(F.coalesce(strong, F.lit(False)), "score_confirmed").otherwise("candidates_unverified"))
    saved = F.when(by_user, F.col("_user")).otherwise(F.col("_first"))
    return picked.select(
        "query_id", F.when(absent, "").otherwise(saved["slug"]).alias("item_id"), status.alias("status"),
        F.when(absent, F.lit(0.0)).otherwise(F.coalesce(saved["match_score"], F.lit(default_confidence)))
        .alias("confidence"))
