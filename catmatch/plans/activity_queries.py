"""Points, levels, badges, territories and collection changes over the activity tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from catmatch import fixed_values as fv
from catmatch.functions import scalars as sc
from catmatch.operators import activity as act, catalog as cat
from catmatch.plans.oracle_views import sql_in
from catmatch.plans.registry import query

CONFIRMED = f"status IN {sql_in(fv.CONFIRMED_STATUSES)}"
LEVEL = "(SELECT count(*) FROM (VALUES (0), (100), (300), (600), (1000), (1600), (2400)) t(x) WHERE x <= {p})"
LOW = "(SELECT max(x) FROM (VALUES (0), (100), (300), (600), (1000), (1600), (2400)) t(x) WHERE x <= {p})"
HIGH = "(SELECT coalesce(min(x), 2400) FROM (VALUES (0), (100), (300), (600), (1000), (1600), (2400)) t(x) WHERE x > {p})"


def territory_mapping(v):
    territories = v.territories.withColumn("registry_order", F.substring("territory_id", 2, 9).cast("int"))
    return cat.territory_of_region(v.scan_log.select("region"), territories)


@query("count_distinct_items", "A16", f"""
    SELECT user_id, count(DISTINCT item_id) AS items FROM scan_log WHERE {CONFIRMED} AND item_id <> '' GROUP BY user_id""")
def count_distinct_items(v):
    return act.count_distinct_items(v.scan_log, "user_id")


PLACED = {"placed": f"""SELECT s.*, territory_id FROM scan_log s LEFT JOIN region_territory USING (region) WHERE {CONFIRMED}"""}


@query("territory_progress", "A17", """
    SELECT t.territory_id, t.name, CASE WHEN locked THEN 0 ELSE coalesce(tried, 0) END AS tried, total_items,
      NOT locked AND coalesce(tried, 0) > 0 AS unlocked, locked, coalesce(samples, '') AS samples
    FROM territories t LEFT JOIN (SELECT territory_id, count(DISTINCT item_id) AS tried FROM placed GROUP BY territory_id) c USING (territory_id)
    LEFT JOIN (SELECT territory_id, string_agg(item_id, ',' ORDER BY n) AS samples FROM (SELECT territory_id, item_id,
      row_number() OVER (PARTITION BY territory_id ORDER BY max((ts, scan_id)) DESC) AS n FROM placed GROUP BY territory_id, item_id)
      WHERE n <= 3 GROUP BY territory_id) s USING (territory_id)""", PLACED)
def territory_progress(v):
    return act.territory_progress(v.scan_log, territory_mapping(v), v.territories)


@query("points_total", "A19", """
    SELECT c_custkey AS user_id, coalesce(sum(delta), 0)::BIGINT AS points FROM customer LEFT JOIN ledger
      ON user_id = c_custkey GROUP BY c_custkey""")
def points_total(v):
    sums = v.ledger.groupBy("user_id").agg(F.sum("delta").alias("_p"))
    users = v.customer.select(F.col("c_custkey").alias("user_id"))
    return users.join(sums, "user_id", "left").select("user_id", F.coalesce("_p", F.lit(0)).alias("points"))


@query("path_summary", "A18", f"""
    SELECT user_id, points, {LEVEL.format(p='points')} AS level,
      round(CASE WHEN {HIGH.format(p='points')} > {LOW.format(p='points')} THEN (points - {LOW.format(p='points')}) / ({HIGH.format(p='points')} - {LOW.format(p='points')})::DOUBLE ELSE 1.0 END, 6) AS progress,
      {LOW.format(p='points')}::BIGINT AS points_from, {HIGH.format(p='points')}::BIGINT AS points_to,
      coalesce(opened, 0) AS opened, coalesce(scans, 0)::BIGINT AS scans, (SELECT count(*) FROM territories WHERE NOT locked) AS territories
    FROM (SELECT user_id, sum(delta)::BIGINT AS points FROM ledger GROUP BY user_id) p LEFT JOIN (
      SELECT user_id, count(*) AS scans, count(DISTINCT CASE WHEN NOT locked THEN territory_id END) AS opened
      FROM placed LEFT JOIN territories USING (territory_id) GROUP BY user_id) s USING (user_id)""", PLACED)
def path_summary(v):
    points = v.ledger.groupBy("user_id").agg(F.sum("delta").alias("points"))
    return act.path_summary(v.scan_log, territory_mapping(v), v.territories, points)


@query("level_for", "Q14", f"""
    SELECT p_partkey, {LEVEL.format(p='p_partkey')} AS level, {LOW.format(p='p_partkey')}::BIGINT AS points_from,
      {HIGH.format(p='p_partkey')}::BIGINT AS points_to FROM part""")
def level_for(v):
    return v.part.select("p_partkey", sc.level_for(F.col("p_partkey")).alias("l")).select(
        "p_partkey", "l.level", "l.points_from", "l.points_to")


@query("running_points", "W9", f"""
    SELECT scan_id, running, {LEVEL.format(p='running')} AS level, {LEVEL.format(p='running')} > {LEVEL.format(p='running - delta')} AS level_up
    FROM (SELECT scan_id, delta, (sum(delta) OVER (PARTITION BY user_id ORDER BY ts, scan_id))::BIGINT AS running FROM ledger)""")
def running_points(v):
    return act.running_points(v.ledger, rows_per_bucket=50).select("scan_id", "running", "level", "level_up")


@query("first_award", "W10", f"""
    SELECT user_id, item_id, min((ts, scan_id)).scan_id AS scan_id, 10 AS points FROM (
      SELECT user_id, item_id, {{'ts': ts, 'scan_id': scan_id}} AS k, ts, scan_id FROM scan_log WHERE {CONFIRMED} AND item_id <> '')
    GROUP BY user_id, item_id""".replace("min((ts, scan_id)).scan_id", "(min(k)).scan_id"))
def first_award(v):
    return act.first_award(v.scan_log).select("user_id", "item_id", "scan_id", "points")


BADGES = {**PLACED, "progress": """SELECT user_id, territory_id, total_items, count(DISTINCT item_id) AS scanned FROM placed
      JOIN territories USING (territory_id) WHERE NOT locked AND total_items > 0 GROUP BY user_id, territory_id, total_items""",
          "counts": """SELECT user_id, count(DISTINCT item_id) AS items FROM placed GROUP BY user_id""",
          "opened": """SELECT user_id, count(*) AS opened FROM progress GROUP BY user_id""",
          "badges": """SELECT user_id, 'first_scan' AS code, 10 AS points FROM counts
      UNION ALL SELECT user_id, 'taster_10', 20 FROM counts WHERE items >= 10 UNION ALL SELECT user_id, 'taster_50', 100 FROM counts WHERE items >= 50
      UNION ALL SELECT user_id, 'explorer_3', 30 FROM opened WHERE opened >= 3 UNION ALL SELECT user_id, 'explorer_5', 100 FROM opened WHERE opened >= 5
      UNION ALL SELECT user_id, 'explorer_8', 200 FROM opened WHERE opened >= (SELECT count(*) FROM territories WHERE NOT locked)
      UNION ALL SELECT user_id, 'pioneer_' || territory_id, 50 FROM progress UNION ALL SELECT user_id, 'expert_' || territory_id, 100
        FROM progress WHERE scanned >= ceil(total_items * 0.5) UNION ALL SELECT user_id, 'legend_' || territory_id, 200 FROM progress WHERE scanned >= total_items"""}


def spread_scans(v):
    """Scans whose region follows the item, so that a user reaches several territories."""
    return v.scan_log.withColumn("region", F.concat(F.lit("Vale of NATION_"), F.col("item_id").cast("int") % 25))


BADGE_VIEWS = {**BADGES, "placed": f"""SELECT s.*, t.territory_id FROM scan_log s LEFT JOIN region_territory t
    ON t.region = 'Vale of NATION_' || (s.item_id::INT % 25) WHERE {CONFIRMED}"""}


@query("award_badges", "Q13", "SELECT user_id, code, points FROM badges", BADGE_VIEWS)
def award_badges(v):
    return act.award_badges(spread_scans(v), territory_mapping(v), v.territories)


@query("award_points", "Q13 A19", """
    SELECT user_id, sum(points)::BIGINT AS points FROM (SELECT user_id, points FROM badges UNION ALL
      SELECT user_id, 10 FROM (SELECT DISTINCT user_id, item_id FROM placed)) GROUP BY user_id""", BADGE_VIEWS)
def award_points(v):
    scans = spread_scans(v)
    badges = act.award_badges(scans, territory_mapping(v), v.territories)
    return act.points_total(act.first_award(scans), badges)


CHANGES = {"changes": """SELECT user_id, 'g' || (substr(slug, 2)::INT % 3) AS slug, ts, order_id * 10 + line AS tie,
      CASE (order_id + line) % 11 WHEN 0 THEN 'remove' WHEN 1 THEN 'set' WHEN 2 THEN 'in_stock' WHEN 3 THEN 'consumed' ELSE 'add' END AS op,
      max(CASE WHEN l_returnflag = 'R' THEN -quantity ELSE quantity % 7 - 1 END) AS n FROM purchases
      GROUP BY ALL"""}


def collection_changes(v):
    number = F.col("order_id") + F.col("line")
    op = (F.when(number % 11 == 0, "remove").when(number % 11 == 1, "set").when(number % 11 == 2, "in_stock")
          .when(number % 11 == 3, "consumed").otherwise("add"))
    rows = v.purchases.select(
        "user_id", F.concat(F.lit("g"), F.substring("slug", 2, 12).cast("int") % 3).alias("slug"), "ts",
        (F.col("order_id") * 10 + F.col("line")).alias("tie"), op.alias("op"),
        F.when(F.col("l_returnflag") == "R", -F.col("quantity")).otherwise(F.col("quantity") % 7 - 1).alias("n"))
    # An order can repeat a line number; one change per order line.
    return rows.groupBy("user_id", "slug", "ts", "tie", "op").agg(F.max("n").alias("n"))


# State -1 stands for "no entry"; the fold walks the ordered log of one key.
@query("apply_collection_changes", "Q15", """
    SELECT user_id, slug, s.n AS quantity, s.op AS status FROM (
      SELECT user_id, slug, list_reduce(list_prepend({'ts': 0::BIGINT, 'tie': 0::BIGINT, 'op': '', 'n': -1::BIGINT}, list(
          {'ts': ts, 'tie': tie, 'op': op, 'n': n} ORDER BY ts, tie)),
        lambda a, x: CASE WHEN x.op = 'remove' THEN {'ts': 0::BIGINT, 'tie': 0::BIGINT, 'op': '', 'n': -1::BIGINT}
          WHEN x.op = 'add' THEN {'ts': 0::BIGINT, 'tie': 0::BIGINT, 'op': CASE WHEN greatest(a.n, 0) + x.n > 0 THEN 'IN_STOCK' ELSE 'CONSUMED' END,
            'n': greatest(greatest(a.n, 0) + x.n, 0)}
          WHEN a.n < 0 THEN a
          WHEN x.op = 'set' THEN {'ts': 0::BIGINT, 'tie': 0::BIGINT, 'op': CASE WHEN x.n > 0 THEN 'IN_STOCK' ELSE 'CONSUMED' END, 'n': greatest(x.n, 0)}
          WHEN x.op = 'in_stock' THEN {'ts': 0::BIGINT, 'tie': 0::BIGINT, 'op': 'IN_STOCK', 'n': greatest(a.n, 1)}
          ELSE {'ts': 0::BIGINT, 'tie': 0::BIGINT, 'op': 'CONSUMED', 'n': a.n} END) AS s
      FROM changes GROUP BY user_id, slug) WHERE s.n >= 0""", CHANGES)
def apply_collection_changes(v):
    return act.replay_collection(collection_changes(v), ["user_id", "slug"], "ts", "tie", "op", "n")


@query("toggle_favorites", "Q16", """
    SELECT user_id, slug, arg_max(kind, (ts, tie)) AS kind FROM (SELECT user_id, 'g' || (substr(slug, 2)::INT % 3) AS slug, ts,
      order_id * 10 + line AS tie, CASE WHEN o_orderpriority < '3' THEN 'LIKED' ELSE 'WISH' END AS kind FROM purchases)
    GROUP BY user_id, slug HAVING count(*) % 2 = 1""")
def toggle_favorites(v):
    kinds = v.purchases.select((F.col("order_id") * 10 + F.col("line")).alias("tie"), "user_id", "ts",
                               F.concat(F.lit("g"), F.substring("slug", 2, 12).cast("int") % 3).alias("slug"),
                               F.when(F.col("o_orderpriority") < "3", "LIKED").otherwise("WISH").alias("kind"))
    return act.toggle_favorites(kinds, ["user_id", "slug"], ["ts", "tie"], "kind")


@query("deadline_miss", "R6", """
    SELECT user_id, item_id, min(CASE WHEN status = 'legacy' THEN ts END) AS started,
      coalesce(min(CASE WHEN status = 'user_confirmed' THEN ts END) - min(CASE WHEN status = 'legacy' THEN ts END) > 86400000000, true) AS missed
    FROM scan_log GROUP BY user_id, item_id HAVING started IS NOT NULL""")
def deadline_miss(v):
    jobs = v.scan_log.withColumn("job", F.struct("user_id", "item_id"))
    misses = act.deadline_misses(jobs, "job", F.col("status") == "legacy", F.col("status") == "user_confirmed",
                                 86_400_000_000)
    return misses.select("job.user_id", "job.item_id", "started", "missed")
