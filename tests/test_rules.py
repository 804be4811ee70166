"""Rules and invariants on hand-made rows."""
import numpy as np
from pyspark.sql import functions as F

from catmatch import fixed_values as fv
from catmatch.functions import scalars as sc, text as tx
from catmatch.operators import activity, catalog, decisions, hybrid, tagging, text_search, visual
from catmatch.operators.catalog import load_catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_load_catalog_layouts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"slug": "a", "title": "A"}\n\n{"slug": "b", "title": "B"}\n')
    (tmp_path / "items.json").write_text('{"items": [{"slug": "c"}, {"slug": "d"}]}')
    (tmp_path / "list.json").write_text('[{"slug": "e"}, {"slug": "f"}]')
    (tmp_path / "one.json").write_text('{"slug": "g", "title": "G"}')
    slugs = lambda name, layout: sorted(r.slug for r in load_catalog(spark, str(tmp_path / name), layout).collect())
    assert slugs("a.jsonl", "jsonl") == ["a", "b"]
    assert slugs("items.json", "document") == ["c", "d"]
    assert slugs("list.json", "document") == ["e", "f"]
    assert slugs("one.json", "document") == ["g"]


def test_two_normalisers_differ(spark):
    assert one(spark, tx.normalize_phrase(F.lit("Белый  ЁЖ_é"))) == "белыи еж e"
    assert one(spark, tx.canonical(F.lit("Белый"))) == "beloe"
    assert one(spark, tx.canonical(F.lit("Щука"))) == "schuka"


def test_tokens_column_and_name_agree(spark):
    df = spark.createDataFrame([("Вино Каберне Совиньон 2019 it's CHÂTEAU red",)], "t string")
    row = df.select(tx.tokens("t").alias("a"), tx.tokens(F.col("t")).alias("b")).first()
    assert row.a == row.b == ["kaberne", "sovinon", "it", "shato", "krasnoe"]


def test_decode_attribute_glyphs(spark):
    assert one(spark, tx.decode_attribute_glyphs(F.lit("KPACHOE cyxoe wine"))) == "красное сухое wine"


def test_product_key_drops_years_and_keeps_equivalents(spark):
    key = lambda slug: one(spark, sc.product_key(F.lit(slug), F.lit("W"), F.lit("merlot"), F.lit("red")))
    assert key("x-2019-y") == key("x-2021-y") != key("x-z")
    pair = list(fv.EQUIVALENT_SLUGS)
    assert key(pair[0]) == key(pair[1])


def test_longest_sweetness_wins_and_grape_masks_colour(spark):
    vocabulary = tagging.phrase_table(spark, "color", fv.COLOR_VOCABULARY).unionByName(
        tagging.phrase_table(spark, "sweetness", fv.SWEETNESS_VOCABULARY)).unionByName(
        tagging.phrase_table(spark, "grapes", {**fv.GRAPE_VOCABULARY, "Мускат Белый": []}))
    lines = spark.createDataFrame([
        (1, 0, "вино полу сладкое", .9, None), (1, 1, "Мускат Белый", .9, True), (2, 0, "KPACHOE dry", .8, True),
        (3, 0, "red", .79, True), (3, 1, "white", float("nan"), True), (3, 2, "white", .9, False),
        (4, 0, "red wine", .9, True), (4, 1, "white", .9, True)],
        "query_id bigint, line_no bigint, text string, confidence double, on_target boolean")
    profile = {(r.query_id, r.attribute): (r.status, r["values"]) for r in tagging.observed_profile(lines, vocabulary).collect()}
    assert profile[1, "sweetness"] == ("read", ["Полусладкое"])
    assert profile[1, "grapes"] == ("read", ["Мускат Белый"])
    assert profile[1, "color"][0] == "missing"
    assert profile[2, "color"] == ("read", ["Красное"]) and profile[2, "sweetness"] == ("read", ["Сухое"])
    assert profile[3, "color"][0] == "missing"
    assert profile[4, "color"] == ("ambiguous", [])


def test_sequential_sweetness(spark):
    lines = spark.createDataFrame([(1, "Экстра-брют", .95, True), (2, "полусухое сухое", .95, True), (3, "brut", .89, True)],
                                  "query_id bigint, text string, confidence double, on_target boolean")
    tags = {(r.query_id, r.value) for r in tagging.sequential_tags(lines).collect()}
    assert tags == {(1, "Экстра брют"), (2, "Полусухое"), (2, "Сухое")}


def test_territory_aliases(spark):
    aliases = [(a, t[0]) for t in fv.TERRITORIES for a in t[1]]
    df = spark.createDataFrame([("Долина Дона",), ("Ставрополье",), ("Дагестан, Дербент",), ("Марс",)], "region string")
    dimension = spark.createDataFrame([(t[0], i, t[1]) for i, t in enumerate(fv.TERRITORIES)],
                                      "territory_id string, registry_order int, aliases array<string>")
    by_rule = {r.region: r.t for r in df.select("region", sc.region_to_territory(F.col("region"), aliases).alias("t")).collect()}
    by_join = {r.region: r.territory_id for r in catalog.territory_of_region(df, dimension).collect()}
    assert by_rule == {"Долина Дона": "don", "Ставрополье": "stavropol", "Дагестан, Дербент": "dagestan", "Марс": None}
    assert by_join == {k: v for k, v in by_rule.items() if v}


CARDS = [("a", "Alma Ridge Reserve", "Alma Valley", "merlot", "red"), ("b", "Sun Hills", "Hill House", "riesling", "white"),
         ("b2", "Sun Hills", "Hill House", "riesling", "white"), ("c", "Night Garden", "Garden Co", "merlot", "red")]


def cards_of(spark):
    return spark.createDataFrame([(*c, None) for c in CARDS], "slug string, title string, winery string, grapes string, category string, region string")


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, line_no bigint, text string, confidence double, on_target boolean")


def test_repeated_reading_changes_nothing_and_limit_keeps_ranks(spark):
    rows = [(1, 0, "ALMA VALEY ridge", .9, True), (2, 0, "sun hills", .9, None)]
    search = lambda r, k: [tuple(x)[:5] for x in text_search.text_search(lines_of(spark, r), cards_of(spark), k).orderBy(
        "query_id", "rank").drop("profile").collect()]
    base = search(rows, 5)
    assert search(rows + [(1, 1, "ALMA VALEY ridge", .9, True), (1, 2, "alma", .5, True)], 5) == base
    assert search(rows, 1) == [r for r in base if r[1] == 1]
    assert [r[2] for r in base if r[0] == 2][:2] == ["b", "b2"]


def views(spark, rng, n, columns):
    return [(*c, [float(x) for x in rng.normal(size=8)]) for c in columns]


def brute_visual(queries, gallery):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    bodies = {g[1] for g in gallery if g[2] == "body"}
    out = {}
    for q, family, vector in queries:
        has_body = any(x[0] == q and x[1] == "body" for x in queries)
        branch = family if family in visual.BRANCHES else "body" if not has_body else None
        for _, record, kind, slugs, other in gallery:
            side = "body" if kind == "body" or (kind == "reference" and record not in bodies) else "detail" if kind in ("label", "flat") else None
            if branch and side == ("body" if branch == "body" else "detail"):
                for s in slugs:
                    key = (q, branch, s)
                    out[key] = max(out.get(key, -9), float(unit(vector) @ unit(other)))
    return out


def test_block_size_and_hot_cards_do_not_change_similarities(spark):
    rng = np.random.default_rng(7)
    families = ["body", "label", "flat", "reference"]
    queries = [(q, f, [float(x) for x in rng.normal(size=8)]) for q in range(9) for f in (families[:3] if q % 3 else ["reference", "label"])]
    gallery = [(i, i // 3, families[i % 4], [f"s{i % 11}"] if i % 2 else ["hot", f"s{i % 5}"], [float(x) for x in rng.normal(size=8)]) for i in range(160)]
    q = spark.createDataFrame(queries, "query_id bigint, family string, vector array<double>")
    g = spark.createDataFrame(gallery, "view_id bigint, record_id bigint, family string, slugs array<string>, vector array<double>")
    expected = brute_visual(queries, gallery)
    for sizes in ({"query_rows": 4, "gallery_rows": 20}, {}):
        rows = visual.max_similarity(q, g, **sizes).collect()
        assert {(r.query_id, r.branch, r.slug) for r in rows} == set(expected)
        assert all(abs(expected[r.query_id, r.branch, r.slug] - r.cosine) < 1e-9 for r in rows)
    whole = visual.weighted_fusion(visual.max_similarity(q, g), visual.available_weights(q, g))
    cut = visual.weighted_fusion(visual.max_similarity(q, g, "fused", 3, query_rows=4, gallery_rows=20), visual.available_weights(q, g))
    def top(df):
        best = {}
        for r in df.collect():
            best.setdefault(r.query_id, []).append((-round(r.visual, 9), r.slug))
        return {k: sorted(v)[:3] for k, v in best.items()}
    assert top(whole) == top(cut)


def test_hybrid_counts_cards_without_views_as_zero(spark):
    q = spark.createDataFrame([(1, "body", [1.0, 0.0])], "query_id bigint, family string, vector array<double>")
    g = spark.createDataFrame([(1, 1, "body", ["a"], [-1.0, 0.0]), (2, 2, "body", ["b"], [-1.0, 1.0])],
                              "view_id bigint, record_id bigint, family string, slugs array<string>, vector array<double>")
    found = hybrid.hybrid_search(q, lines_of(spark, [(1, 0, "garden", .3, True)]), g, cards_of(spark), 4).orderBy("rank").collect()
    assert [r.slug for r in found][-1] == "a"
    assert {r.slug: round(r.visual_similarity, 6) for r in found}["b2"] == 0.0


def membership(spark, score=.9, n=5):
    rows = [(1, f"s{i}", i + 1, score - i / 10, .9 - i / 10, 1.0, False, []) for i in range(n)]
    candidates = spark.createDataFrame(rows, "query_id bigint, slug string, rank bigint, score double, visual_similarity double, text_score double, producer_match boolean, conflicts array<string>")
    cards = spark.createDataFrame([(f"s{i}", f"name{i}", "House", "merlot", "red") for i in range(n)],
                                  "slug string, title string, winery string, grapes string, category string")
    evidence = spark.createDataFrame([(1, "s0", "title", "name0", .9, .9)],
                                     "query_id bigint, slug string, field string, term string, confidence double, match_strength double")
    ocr = spark.createDataFrame([(1, True)], "query_id bigint, ocr_available boolean")
    return candidates, decisions.membership_features(candidates, evidence, cards, ocr)


MODEL = {"mean": [0.0] * 18, "scale": [1.0] * 18, "coefficients": [0.0] * 18, "intercept": -9.0, "reject_below": .5}


def test_missing_evidence_never_rejects(spark):
    _, full = membership(spark)
    _, four = membership(spark, n=4)
    assert decisions.refuse_unknown(full, MODEL).first().reject
    short = decisions.refuse_unknown(four, MODEL).first()
    assert not short.reject and short.reason == "complete_top5_required"
    _, broken = membership(spark, score=.9)
    broken = broken.withColumn("valid", F.lit(False))
    assert decisions.refuse_unknown(broken, MODEL).first().reason == "invalid_evidence_keep_candidates"


def test_scores_keep_order_and_respect_the_cap(spark):
    candidates, features = membership(spark)
    model = {"mean": [0.0] * 20, "scale": [1.0] * 20, "coefficients": [2.0] + [0.0] * 19, "intercept": 3.0, "refusal_cap": .2}
    decision = decisions.refuse_unknown(features, MODEL)
    scored = decisions.score_candidates(candidates, features, model, decision).orderBy("rank").collect()
    assert all(r.scored_match <= .2 for r in scored)
    free = decisions.score_candidates(candidates, features, model, decision.withColumn("reject", F.lit(False))).orderBy("rank").collect()
    assert [r.scored_match for r in free] == sorted((r.scored_match for r in free), reverse=True)


def test_level_bounds(spark):
    df = spark.createDataFrame([(0, 1), (99, 1), (100, 2), (2399, 6), (2400, 7), (9999, 7)], "p bigint, level bigint")
    assert all(r.level == r.l.level for r in df.withColumn("l", sc.level_for(F.col("p"))).collect())


def test_collection_replay_rules(spark):
    log = [("k1", 1, 1, "set", 5), ("k1", 2, 2, "add", -3), ("k2", 1, 1, "add", 2), ("k2", 2, 2, "consumed", 0),
           ("k3", 1, 1, "add", 2), ("k3", 2, 2, "add", -9), ("k3", 3, 3, "in_stock", 0), ("k4", 1, 1, "add", 1), ("k4", 2, 2, "remove", 0)]
    df = spark.createDataFrame(log, "slug string, ts bigint, tie bigint, op string, n bigint")
    state = {r.slug: (r.quantity, r.status) for r in activity.replay_collection(df, ["slug"], "ts", "tie", "op", "n", 2).collect()}
    assert state == {"k1": (0, "CONSUMED"), "k2": (2, "CONSUMED"), "k3": (1, "IN_STOCK")}


def test_reply_routes(spark):
    text = one(spark, activity.reply(F.lit("При какой температуре пить?"), F.lit("N"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("White")))
    assert text == "Подавайте N при 8-12°C."
