"""Filters, joins, set operations, ranking and collection queries."""
from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from catmatch import fixed_values as fv
from catmatch.functions import scalars as sc
from catmatch.operators import ranking as rk
from catmatch.plans.oracle_views import sql_in, tokens
from catmatch.plans.registry import query

CONFIRMED = sql_in(fv.CONFIRMED_STATUSES)


# ------------------------------------------------------------------- filters
@query("collection_filter", "F4", """
    SELECT user_id, c.slug, quantity FROM cellar c JOIN cards USING (slug) WHERE status = 'IN_STOCK'
      AND category = 'SMALL' AND (contains(lower(title), 'ring') OR contains(lower(winery), 'ring'))""")
def collection_filter(v):
    from catmatch.operators.activity import filter_collection
    owned = v.cellar.join(v.cards.select("slug", "title", "winery", "category"), "slug")
    return filter_collection(owned, "status", "IN_STOCK", "SMALL", " Ring ").select("user_id", "slug", "quantity")


@query("confirmed_only", "F5", f"SELECT scan_id, status FROM scan_log WHERE status IN {CONFIRMED}")
def confirmed_only(v):
    from catmatch.operators.activity import confirmed_only as op
    return op(v.scan_log).select("scan_id", "status")


@query("hard_constraints", "F7", """
    SELECT slug, q.query_id FROM cards JOIN (SELECT query_id, max(CASE WHEN contains(text, 'red') THEN 'red'
      WHEN contains(text, 'blue') THEN 'blue' END) AS color, min(split_part(text, ' ', 3)) AS sweetness,
      min(split_part(text, ' ', 2)) AS grape FROM part_lines GROUP BY query_id) q ON grapes = grape
      WHERE (q.sweetness IS NULL OR q.sweetness = category) AND (color IS NULL OR color = split_part(title, ' ', 1))""")
def hard_constraints(v):
    words = F.split("text", " ")
    asked = v.part_lines.groupBy("query_id").agg(
        F.max(F.when(F.contains("text", F.lit("red")), "red")
              .when(F.contains("text", F.lit("blue")), "blue")).alias("color"),
        F.min(words[2]).alias("sweetness"), F.min(words[1]).alias("grapes"))
    cards = v.cards.select("slug", "grapes", F.col("category").alias("card_sweetness"),
                           F.split("title", " ")[0].alias("card_color"))
    from catmatch.operators.recommend import cards_within
    return cards_within(asked, cards)


@query("exists_key", "F8", """
    SELECT f.user_id, f.slug, kind FROM favorites f WHERE EXISTS (SELECT 1 FROM cellar c
      WHERE c.user_id = f.user_id AND c.slug = f.slug AND status = 'IN_STOCK')""")
def exists_key(v):
    stocked = v.cellar.filter("status = 'IN_STOCK'")
    return v.favorites.join(stocked, ["user_id", "slug"], "left_semi").select("user_id", "slug", "kind")


# --------------------------------------------------------------------- joins
@query("candidates_with_cards", "J1", """
    SELECT query_id, rank, c.slug, title, winery FROM candidates c JOIN cards USING (slug)""")
def candidates_with_cards(v):
    return v.candidates.join(v.cards.select("slug", "title", "winery"), "slug").select(
        "query_id", "rank", "slug", "title", "winery")


@query("missing_cards", "J1", """
    SELECT query_id, slug FROM candidates WHERE slug NOT IN (SELECT slug FROM known)""")
def missing_cards(v):
    return v.candidates.join(v.known.select("slug"), "slug", "left_anti").select("query_id", "slug")


@query("collection_with_cards", "J2", """
    SELECT user_id, c.slug, quantity, coalesce(name, title) AS name FROM cellar c
      LEFT JOIN known k ON c.slug = k.slug LEFT JOIN feed_list f ON c.slug = f.slug
      WHERE coalesce(name, title) IS NOT NULL""")
def collection_with_cards(v):
    from catmatch.operators.activity import resolve_cards
    return resolve_cards(v.cellar.select("user_id", "slug", "quantity"), v.known.select("slug", "name"),
                         v.feed_list.select("slug", F.col("title").alias("name")))


@query("family_variants", "J7", """
    SELECT slug, count(*) OVER (PARTITION BY lower(title), lower(winery), lower(grapes), lower(category)) AS family_size
    FROM cards QUALIFY family_size > 1""")
def family_variants(v):
    from catmatch.operators.decisions import family_key
    keyed = v.cards.select("slug", family_key().alias("family")).filter("family is not null")
    sizes = keyed.groupBy("family").agg(F.count(F.lit(1)).alias("family_size")).filter("family_size > 1")
    return keyed.join(sizes, "family").select("slug", "family_size")


@query("new_keys", "J10", """
    SELECT record_id, count(*) AS views FROM gallery_views WHERE record_id NOT IN (
      SELECT record_id FROM gallery_views WHERE family = 'body') GROUP BY record_id""")
def new_keys(v):
    gallery = v.gallery_views
    bodies = gallery.filter("family = 'body'").select("record_id")
    return gallery.join(bodies, "record_id", "left_anti").groupBy("record_id").agg(
        F.count(F.lit(1)).alias("views"))


@query("scans_with_chats", "J11", """
    SELECT scan_id, user_id FROM scan_log WHERE scan_id IN (SELECT conv_id FROM conversations)""")
def scans_with_chats(v):
    chats = v.conversations.select(F.col("conv_id").alias("scan_id"))
    return v.scan_log.join(chats, "scan_id", "left_semi").select("scan_id", "user_id")


@query("fresh_heartbeats", "J12", """
    SELECT user_id, max(ts) AS last_seen, bool_or(ts > (SELECT max(ts) FROM scan_log) - 86400000000
      AND item_id::INT % 2 = 0) AS ready FROM scan_log GROUP BY user_id""")
def fresh_heartbeats(v):
    from catmatch.operators.activity import liveness
    beats = v.scan_log.select("user_id", "ts", (F.col("item_id").cast("int") % 2 == 0).alias("same_version"))
    as_of = v.scan_log.agg(F.max("ts")).scalar()
    return liveness(beats, "user_id", "ts", as_of, 86_400_000_000)


@query("worker_at_event", "J12", """
    WITH beats AS (SELECT CASE WHEN scan_id % 2 = 0 THEN 0 ELSE user_id END AS worker, ts, max(scan_id) AS beat FROM scan_log
        WHERE status IN ('candidates_unverified', 'not_in_catalog') GROUP BY ALL),
      jobs AS (SELECT CASE WHEN scan_id % 2 = 0 THEN 0 ELSE user_id END AS worker, ts, scan_id FROM scan_log WHERE status NOT IN ('candidates_unverified', 'not_in_catalog'))
    SELECT jobs.scan_id, jobs.worker, CASE WHEN jobs.ts - beats.ts <= 3600000000 THEN beats.beat END AS beat,
      coalesce(jobs.ts - beats.ts <= 3600000000, false) AS alive
    FROM jobs ASOF LEFT JOIN beats ON jobs.worker = beats.worker AND jobs.ts >= beats.ts""")
def worker_at_event(v):
    """Half of all events belong to worker 0."""
    log = v.scan_log.withColumn("worker", F.when(F.col("scan_id") % 2 == 0, 0).otherwise(F.col("user_id")))
    is_beat = F.col("status").isin("candidates_unverified", "not_in_catalog")
    beats = log.filter(is_beat).select("worker", "ts", F.col("scan_id").alias("beat"))
    found = rk.asof_last(log.filter(~is_beat).select("worker", "ts", "scan_id"), beats, ["worker"], "ts", 3_600_000_000, rows_per_bucket=1000)
    return found.select("scan_id", "worker", "last.beat", F.col("last").isNotNull().alias("alive"))


@query("cascade_delete", "J13", """
    SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (
      SELECT scan_id FROM scan_log WHERE status = 'not_in_catalog')""")
def cascade_delete(v):
    deleted = v.scan_log.filter("status = 'not_in_catalog'").select(F.col("scan_id").alias("conv_id"))
    return v.conversations.join(deleted, "conv_id", "left_anti").select("conv_id", "turn")


# ------------------------------------------------------------------- windows
@query("rank_candidates", "W1", """
    SELECT query_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS rank FROM scored_pairs""")
def rank_candidates(v):
    pairs = v.scored_pairs.select("query_id", "slug", "score")
    return rk.rank_candidates(pairs, "query_id", "score", "slug", rows_per_bucket=20).select("query_id", "slug", "rank")


@query("tied_rank", "W2", """
    SELECT query_id, slug, last_value(CASE WHEN fresh THEN rn END IGNORE NULLS) OVER (
      PARTITION BY query_id ORDER BY rn) AS tied_rank FROM (
      SELECT *, coalesce(abs(visual_similarity - lag(visual_similarity) OVER (PARTITION BY query_id ORDER BY rn)) > 0.00001, true) AS fresh
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY visual_similarity DESC, slug) AS rn
        FROM scored_pairs))""")
def tied_rank(v):
    pairs = v.scored_pairs.select("query_id", "slug", "visual_similarity")
    return rk.tied_rank(pairs, "query_id", "visual_similarity", "slug", 1e-5).select(
        "query_id", "slug", "tied_rank")


@query("relative_margin", "W3", """
    SELECT query_id, round(max(CASE WHEN rn = 1 THEN text_score END), 6) AS first,
      round(CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE (max(CASE WHEN rn = 1 THEN text_score END) - max(CASE WHEN rn = 2 THEN text_score END))
        / greatest(abs(max(CASE WHEN rn = 1 THEN text_score END)), 1) END, 6) AS margin FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, slug) AS rn FROM scored_pairs) GROUP BY query_id""")
def relative_margin(v):
    out = rk.relative_margin(v.scored_pairs.select("query_id", "text_score"), "query_id", "text_score")
    return out.select("query_id", F.round("first", 6).alias("first"), F.round("margin", 6).alias("margin"))


@query("top1_gap", "W4", """
    SELECT query_id, round(max(CASE WHEN rank = 1 THEN match_score END) - max(CASE WHEN rank > 1 THEN match_score END), 6) AS top1_gap
    FROM candidates GROUP BY query_id""")
def top1_gap(v):
    gaps = rk.top1_gap(v.candidates, "query_id", "match_score")
    return gaps.select("query_id", F.round("top1_gap", 6).alias("top1_gap"))


@query("gap_to_best", "W5", """
    SELECT query_id, slug, round(score - max(score) OVER (PARTITION BY query_id), 9) AS gap_to_best FROM scored_pairs""")
def gap_to_best(v):
    out = rk.gap_to_best(v.scored_pairs.select("query_id", "slug", "score"), "query_id", "score")
    return out.select("query_id", "slug", F.round("gap_to_best", 9).alias("gap_to_best"))


@query("keep_within", "W6", """
    SELECT query_id, slug FROM (SELECT query_id, slug, score, row_number() OVER w AS rn, first_value(score) OVER w AS best
      FROM scored_pairs WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, slug)) WHERE rn <= 5 AND score >= best - 0.08""")
def keep_within(v):
    pairs = v.scored_pairs.select("query_id", "slug", "score")
    return rk.keep_within(pairs, ["query_id"], "score", "slug", 0.08, 5).select("query_id", "slug")


@query("near_tie", "W7", """
    SELECT query_id, slug, round(first - score, 9) AS gap FROM (SELECT *, first_value(score) OVER (
      PARTITION BY query_id ORDER BY rank) AS first FROM candidates) WHERE first - score BETWEEN 0 AND 0.03""")
def near_tie(v):
    close = rk.near_tie(v.candidates.select("query_id", "slug", "score", "rank"), "query_id", "score", 0.03)
    return close.select("query_id", "slug", F.round("gap", 9).alias("gap"))


@query("first_n", "W8", """
    SELECT word, query_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY confidence DESC, query_id, line_no) AS rn
      FROM (SELECT split_part(text, ' ', 1) AS word, query_id, line_no, confidence FROM part_lines)) WHERE rn <= 3""")
def first_n(v):
    lines = v.part_lines.select(F.split("text", " ")[0].alias("word"), "query_id", "line_no", "confidence")
    order = [F.col("confidence").desc(), F.col("query_id"), F.col("line_no")]
    return rk.top_k(lines, ["word"], order, 3).select("word", "query_id", "line_no")


@query("latest_status", "W12", """
    SELECT user_id, scan_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, scan_id DESC) AS rn
      FROM scan_log) WHERE rn = 1""")
def latest_status(v):
    log = v.scan_log.select("user_id", "scan_id", "ts", "status")
    return rk.latest_by(log, ["user_id"], ["ts", "scan_id"]).select("user_id", "scan_id", "status")


@query("preserve_first_ts", "W11", """
    SELECT user_id, item_id, min(ts) AS ts, arg_max(status, (ts, scan_id)) AS status FROM scan_log GROUP BY user_id, item_id""")
def preserve_first_ts(v):
    log = v.scan_log.select("user_id", "item_id", "ts", "status", "scan_id")
    return rk.preserve_first_ts(log, ["user_id", "item_id"], "ts", "scan_id").select(
        "user_id", "item_id", "ts", "status")


STABLE_SQL = """
    WITH e AS (SELECT user_id, ts, event_type <> 'error' AS good, value < 60 AS over FROM scan_events),
    seen AS (SELECT *, coalesce(last_value(CASE WHEN good THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last,
      coalesce(lag(good) OVER (PARTITION BY user_id ORDER BY ts), false) AS prev_good FROM e),
    runs AS (SELECT *, sum(CASE WHEN good AND (NOT prev_good OR NOT over OR ts - last > 43200000000) THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts) AS run,
      sum(CASE WHEN NOT good AND ts - last > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS episode FROM seen),
    counted AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts) AS frames FROM runs WHERE good)
    SELECT user_id, min(ts) AS ts FROM counted WHERE frames >= 3 GROUP BY user_id, episode"""


def stable_events(v):
    return v.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
                           "event_type", "value")


@query("consecutive_stable", "W13 R5", STABLE_SQL.replace(
    "scan_events", "(SELECT user_id, epoch_us(ts) AS ts, event_type, value FROM events)"))
def consecutive_stable(v):
    return rk.stable_triggers(stable_events(v), "user_id", "ts", F.col("event_type") != "error",
                              F.col("value") < 60, 3, 43_200_000_000, 7_200_000_000, rows_per_bucket=15)


# -------------------------------------------------------------- sorts, limits
@query("top_k_per_query", "O2", """
    SELECT query_id, slug, rank FROM (SELECT query_id, slug, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, slug) AS rank FROM scored_pairs) WHERE rank <= 10""")
def top_k_per_query(v):
    pairs = v.scored_pairs.select("query_id", "slug", "score")
    return rk.top_k(pairs, ["query_id"], [F.col("score").desc(), F.col("slug")], 10).select(
        "query_id", "slug", "rank")


@query("limit_output", "O3", """
    SELECT query_id, slug, rank FROM candidates WHERE rank <= CASE WHEN query_id % 2 = 0 THEN 5 ELSE 1 END""")
def limit_output(v):
    from catmatch.operators.decisions import visible
    return visible(v.candidates, F.col("query_id") % 2 == 0).select("query_id", "slug", "rank")


def _sorted(key):
    return f"""SELECT user_id, slug, position FROM (SELECT user_id, slug, row_number() OVER (
      PARTITION BY user_id ORDER BY {key}, slug) AS position FROM favorites f JOIN cards USING (slug))"""


for _name, _sql in [("newest", "added_at DESC"), ("oldest", "added_at"),
                    ("rating", "coalesce(CASE WHEN size % 4 <> 0 THEN price END, -1) DESC"),
                    ("name", "lower(title)")]:
    @query(f"sort_collection_{_name}", "O4", _sorted(_sql))
    def sort_collection(v, name=_name):
        from catmatch.operators.activity import collection_order
        owned = v.favorites.join(v.cards.select("slug", "title", F.when(
            F.col("size") % 4 != 0, F.col("price")).alias("rating")), "slug")
        order = [*collection_order(name, "added_at"), F.col("slug")]
        position = F.row_number().over(W.partitionBy("user_id").orderBy(*order)).cast("bigint")
        return owned.withColumn("position", position).select("user_id", "slug", "position")


@query("dashboard_sections", "O5", """
    SELECT section, slug, user_id FROM (SELECT 'favorites' AS section, slug, user_id, row_number() OVER (ORDER BY added_at DESC, user_id, slug) AS n FROM favorites
    UNION ALL SELECT 'collection', slug, user_id, row_number() OVER (ORDER BY updated_at DESC, user_id, slug) FROM cellar
    UNION ALL SELECT 'scans', item_id, user_id, row_number() OVER (ORDER BY ts DESC, user_id, item_id) FROM scan_log) WHERE n <= 3""")
def dashboard_sections(v):
    from catmatch.operators.activity import dashboard
    return dashboard(
        favorites=v.favorites.select("slug", "user_id", F.col("added_at").alias("ts")),
        collection=v.cellar.select("slug", "user_id", F.col("updated_at").alias("ts")),
        scans=v.scan_log.select(F.col("item_id").alias("slug"), "user_id", "ts"))


@query("recent", "O6", "SELECT scan_id, ts FROM scan_log ORDER BY ts DESC, scan_id LIMIT 25")
def recent(v):
    return v.scan_log.select("scan_id", "ts").orderBy(F.col("ts").desc(), "scan_id").limit(25)


@query("similar_cards", "O8", """
    SELECT slug, similar_slug, position FROM (SELECT a.slug, b.slug AS similar_slug, row_number() OVER (
        PARTITION BY a.slug ORDER BY b.title, b.slug) AS position FROM (SELECT slug, title, category FROM cards) a
      JOIN (SELECT slug, title, category, row_number() OVER (PARTITION BY grapes, category ORDER BY title, slug) AS n, grapes FROM cards) b
      ON b.grapes = split_part(a.title, ' ', 2) AND b.category = a.category AND b.n <= 5 AND a.slug <> b.slug) WHERE position <= 4""")
def similar_cards(v):
    from catmatch.operators.recommend import similar_cards as op
    return op(v.cards, 4)


@query("random_draw", "O9", """
    SELECT sector, slug FROM (SELECT slug, row_number() OVER (ORDER BY (p_partkey * 48271 + 11) % 2147483647, slug) - 1 AS n
      FROM cards WHERE category = 'PROMO') p, (SELECT unnest(range(17)) AS sector), (SELECT count(*) AS total FROM cards WHERE category = 'PROMO')
      WHERE n = sector % least(total, 17)""")
def random_draw(v):
    from catmatch.operators.recommend import random_draw as op
    pool = v.cards.filter("category = 'PROMO'")
    return op(pool, "slug", (F.col("p_partkey") * 48271 + 11) % 2147483647, fv.DRAW_SECTORS)


# -------------------------------------------------------------- set operations
@query("union_pages", "U1", """
    SELECT slug, min(page) AS page FROM (SELECT slug, 1 AS page FROM cards WHERE contains(title, 'red')
      UNION ALL SELECT slug, 2 FROM cards WHERE category = 'SMALL') GROUP BY slug""")
def union_pages(v):
    first = v.cards.filter(F.contains("title", F.lit("red"))).select("slug", F.lit(1).alias("page"))
    second = v.cards.filter("category = 'SMALL'").select("slug", F.lit(2).alias("page"))
    return rk.first_by(first.unionByName(second), ["slug"], ["page"])


@query("grape_overlap", "U2", """
    SELECT query_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS common,
      array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS unmatched FROM (
      SELECT a.query_id, list_distinct(string_split(a.text, ' ')) AS a, string_split(b.text, ' ') AS b FROM part_lines a
      JOIN part_lines b ON a.query_id = b.query_id AND a.line_no = 0 AND b.line_no = 1)""")
def grape_overlap(v):
    words = v.part_lines.groupBy("query_id").agg(
        F.max(F.when(F.col("line_no") == 0, F.split("text", " "))).alias("a"),
        F.max(F.when(F.col("line_no") == 1, F.split("text", " "))).alias("b")).filter(
        "a is not null and b is not null")
    return words.select(
        "query_id", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("common"),
        F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("unmatched"))


TITLE_TERMS = f"list_filter(list_distinct({tokens('title')}), lambda t: NOT list_contains({tokens('winery')}, t) AND t NOT IN {sql_in(fv.COLOR_TERMS + fv.SWEETNESS_TERMS)})"


@query("title_terms", "U3", f"SELECT slug, array_to_string(list_sort({TITLE_TERMS}), ',') AS terms FROM cards")
def title_terms(v):
    from catmatch.operators.decisions import title_terms as op
    return v.cards.select("slug", F.array_join(F.array_sort(op()), ",").alias("terms"))


@query("distinctive_terms", "U4", """
    SELECT item_id, term FROM bench_terms WHERE term NOT IN (
      SELECT term FROM bench_terms GROUP BY term HAVING count(DISTINCT item_id) > 1)""")
def distinctive_terms(v):
    from catmatch.operators.decisions import distinctive_terms as op
    return op(v.bench_terms, "item_id", "term")


@query("union_evidence", "U5", """
    SELECT query_id, slug, round(max(greatest(least(s, 1), 0)), 6) AS support FROM (
      SELECT query_id, slug, confidence * match_strength AS s FROM evidence WHERE field = 'winery'
      UNION ALL SELECT query_id, slug, match_score AS s FROM candidates WHERE producer_match) GROUP BY query_id, slug""")
def union_evidence(v):
    shortlist = v.candidates
    by_field = v.evidence_of(shortlist).filter("field = 'winery'").select(
        "query_id", "slug", sc.evidence_strength(F.col("confidence"), F.col("match_strength")).alias("s"))
    by_route = shortlist.filter("producer_match").select(
        "query_id", "slug", sc.clip(F.col("match_score"), 0, 1).alias("s"))
    return by_field.unionByName(by_route).groupBy("query_id", "slug").agg(F.round(F.max("s"), 6).alias("support"))


@query("same_inventory", "U6", """
    SELECT (SELECT count(*) FROM (SELECT DISTINCT 'b' || label AS slug FROM embeddings EXCEPT SELECT slug FROM bench_cards)) AS only_vectors,
      (SELECT count(*) FROM (SELECT slug FROM bench_cards EXCEPT SELECT 'b' || label FROM embeddings)) AS only_cards""")
def same_inventory(v):
    vectors = v.embeddings.select(F.concat(F.lit("b"), "label").alias("slug")).distinct()
    cards = v.bench_cards.select("slug").distinct()
    sides = (vectors.withColumn("side", F.lit("v")).unionByName(cards.withColumn("side", F.lit("c")))
             .groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("side")))
    return sides.agg(F.count_if((F.col("n") == 1) & (F.col("side") == "v")).alias("only_vectors"),
                     F.count_if((F.col("n") == 1) & (F.col("side") == "c")).alias("only_cards"))


@query("subset_test", "U7", """
    SELECT query_id, line_no, list_has_all(string_split(text, ' '), [split_part(text, ' ', 2), 'ring']) AS subset FROM part_lines""")
def subset_test(v):
    words = F.split("text", " ")
    wanted = F.array(words[1], F.lit("ring"))
    return v.part_lines.select("query_id", "line_no", (F.size(F.array_except(wanted, words)) == 0).alias("subset"))


# ---------------------------------------------------------- collection, chats
@query("collection_stats", "A20", """
    WITH owned AS (SELECT user_id, quantity, category, CASE WHEN size % 4 <> 0 THEN price END AS rating FROM cellar JOIN cards USING (slug))
    SELECT a.user_id, bottles, mean_rating, style FROM (SELECT user_id, sum(quantity)::BIGINT AS bottles, round(avg(rating), 6) AS mean_rating
      FROM owned GROUP BY user_id) a JOIN (SELECT user_id, category AS style FROM (SELECT user_id, category,
      row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS rn FROM owned GROUP BY user_id, category)
      WHERE rn = 1) b USING (user_id)""")
def collection_stats(v):
    from catmatch.operators.activity import collection_stats as op
    owned = v.cellar.join(v.cards.select("slug", "category", F.when(
        F.col("size") % 4 != 0, F.col("price")).alias("rating")), "slug")
    return op(owned, "user_id", "quantity", "rating", "category")


@query("chat_summary", "A21", """
    SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS last_text, count(*) AS messages FROM conversations GROUP BY conv_id""")
def chat_summary(v):
    return v.conversations.groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.max_by("text", "turn").alias("last_text"),
        F.count(F.lit(1)).alias("messages"))


@query("stage_timings", "A22", """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 2) AS total, max(value) AS longest FROM events GROUP BY event_type""")
def stage_timings(v):
    return v.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("longest"))


@query("keyword_route", "T13", """
    SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'pairing' WHEN contains(lower(text), 'une') OR contains(lower(text), 'der') THEN 'analogues'
      WHEN contains(lower(text), 'que') THEN 'region' ELSE 'other' END AS route FROM (
      SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def keyword_route(v):
    from catmatch.operators.activity import last_question, route_of
    routes = [("pairing", ["the"]), ("analogues", ["une", "der"]), ("region", ["que"])]
    asked = last_question(v.conversations)
    return asked.select("conv_id", "turn", route_of(F.col("text"), routes).alias("route"))


@query("reply_template", "T13", """
    SELECT conv_id, 'X сочетается с ' || CASE conv_id % 3 WHEN 0 THEN 'мясными блюдами, сырами с плесенью, тёмным шоколадом.'
      WHEN 1 THEN 'морепродуктами, птицей, салатами.' ELSE 'сырами, орехами и основными блюдами по сезону.' END AS reply
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user')""")
def reply_template(v):
    from catmatch.operators.activity import last_question, reply
    asked = last_question(v.conversations).withColumn("text", F.concat("text", F.lit(" Сочетание?")))
    style = F.when(F.col("conv_id") % 3 == 0, "Red").when(F.col("conv_id") % 3 == 1, "dry white")
    return asked.select("conv_id", reply(F.col("text"), F.lit("X"), F.lit(None).cast("string"),
                                         F.lit(None).cast("string"), style).alias("reply"))
