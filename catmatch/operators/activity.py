"""Scan history, collections, points, badges and territory progress."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catmatch import fixed_values as fv
from catmatch.functions import scalars as sc
from catmatch.functions.text import fold_case
from catmatch.operators.ranking import first_by, join_null_safe, running_sum
from catmatch.sources.tables import keep


def confirmed_only(scans: DataFrame) -> DataFrame:
    return scans.filter(F.col("status").isin(fv.CONFIRMED_STATUSES))


def filter_collection(items: DataFrame, kind_column: str, kind: str | None = None,
                      style: str | None = None, needle: str = "") -> DataFrame:
    """Optional equality on kind and style, and a name or winery substring."""
    if kind is not None:
        items = items.filter(F.col(kind_column) == kind)
    if style is not None:
        items = items.filter(F.col("category") == style)
    wanted = needle.strip().casefold()
    if wanted:
        hit = (F.contains(fold_case(F.col("title")), F.lit(wanted))
               | F.coalesce(F.contains(fold_case(F.col("winery")), F.lit(wanted)), F.lit(False)))
        items = items.filter(hit)
    return items


def collection_order(name: str, ts: str) -> list[Column]:
    return {"newest": [F.col(ts).desc()], "oldest": [F.col(ts)],
            "rating": [F.coalesce(F.col("rating"), F.lit(-1.0)).desc()],
            "name": [F.lower("title")]}[name]


def resolve_cards(items: DataFrame, store: DataFrame, file: DataFrame) -> DataFrame:
    """Items with the card name from the store, else the file; unknown cards drop out."""
    first = store.select("slug", F.col("name").alias("_store"))
    second = file.select("slug", F.col("name").alias("_file"))
    return (items.join(first, "slug", "left").join(second, "slug", "left")
            .withColumn("name", F.coalesce("_store", "_file")).filter("name is not null")
            .drop("_store", "_file"))


def dashboard(n: int = 3, **sections: DataFrame) -> DataFrame:
    """Latest n rows of each section; every frame has slug, user_id and ts."""
    parts = [rows.orderBy(F.col("ts").desc(), "user_id", "slug").limit(n)
             .select(F.lit(name).alias("section"), "slug", "user_id")
             for name, rows in sections.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def collection_stats(items: DataFrame, user: str, quantity: str, rating: str, style: str) -> DataFrame:
    """Bottles, mean known rating and most frequent style (first by name when tied).

    Two levels of aggregation: (user, style) counts combine map-side, so a
    user with very many rows shrinks to one row per style first.
    """
    by_style = items.groupBy(user, style).agg(
        F.sum(quantity).alias("_q"), F.sum(rating).alias("_r"), F.count(rating).alias("_nr"),
        F.count(F.lit(1)).alias("_n"))
    most = F.min(F.when(F.col(style).isNotNull(), F.struct(-F.col("_n"), F.col(style).alias("style"))))
    return by_style.groupBy(user).agg(
        F.sum("_q").alias("bottles"), F.round(F.sum("_r") / F.sum("_nr"), 6).alias("mean_rating"),
        most["style"].alias("style"))


def liveness(beats: DataFrame, key: str, ts: str, as_of: Column, within: int) -> DataFrame:
    """Last beat per key, and whether one within the window carries the current version."""
    fresh = (F.col(ts) > as_of - within) & F.col("same_version")
    return beats.groupBy(key).agg(F.max(ts).alias("last_seen"), F.bool_or(fresh).alias("ready"))


def last_question(dialogs: DataFrame) -> DataFrame:
    return dialogs.filter("role = 'user'").groupBy("conv_id").agg(
        F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def route_of(text: Column, routes=tuple(fv.REPLY_ROUTES), default: str = "other") -> Column:
    """The first route one of whose keywords the lower-cased question contains."""
    low = F.lower(text)
    chosen = F.lit(default)
    for name, keywords in reversed(routes):
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(low, F.lit(keyword))
        chosen = F.when(hit, F.lit(name)).otherwise(chosen)
    return chosen


def reply(question: Column, name: Column, region: Column, variety: Column, style: Column) -> Column:
    """Answer template of the question's route, filled from the card context."""
    low = F.lower(F.coalesce(style, F.lit("")))

    def by_style(options: dict[str, str]) -> Column:
        chosen = F.lit(options[""])
        for key in [k for k in reversed(list(options)) if k]:
            chosen = F.when(F.contains(low, F.lit(key)), F.lit(options[key])).otherwise(chosen)
        return chosen

    route = route_of(question)
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    extra = F.concat(F.when(known(region), F.concat(F.lit(" Регион: "), region, F.lit("."))).otherwise(""),
                     F.when(known(variety), F.concat(F.lit(" Сорт: "), variety, F.lit("."))).otherwise(""))
    analogues = F.concat(
        F.lit("Для "), name, F.lit(" из "),
        F.when(known(region), region).otherwise("известного региона"), F.lit(" ("),
        F.when(known(variety), variety).otherwise("сорт"), F.lit(") ищите вина того же региона и сорта."))
    about_region = F.when(known(region), F.concat(region, F.lit(" задаёт характер "), name, F.lit(
        ". Это типичный пример местного стиля."))).otherwise(
        F.concat(name, F.lit(": уточните, что именно интересует в регионе.")))
    return (F.when(route == "pairing", F.concat(name, F.lit(" сочетается с "), by_style(fv.REPLY_PAIRINGS)))
            .when(route == "analogues", analogues).when(route == "region", about_region)
            .when(route == "ageing", F.concat(name, F.lit(" обычно пьют через "), by_style(fv.REPLY_AGEING),
                                              F.lit(" после урожая.")))
            .when(route == "temperature", F.concat(F.lit("Подавайте "), name, F.lit(" при "),
                                                   by_style(fv.REPLY_TEMPERATURES), F.lit(".")))
            .otherwise(F.concat(name, F.lit(" — хороший выбор."), extra, F.lit(
                " Задайте вопрос про гастропару, регион или аналоги."))))


def count_distinct_items(scans: DataFrame, user: str) -> DataFrame:
    found = confirmed_only(scans).filter("item_id is not null and item_id <> ''")
    return found.select(user, "item_id").distinct().groupBy(user).agg(F.count(F.lit(1)).alias("items"))


def with_territory(scans: DataFrame, mapping: DataFrame) -> DataFrame:
    """Scans with the territory of their raw region; `mapping` has one row per region."""
    return scans.join(mapping, "region", "left")


def territory_progress(scans: DataFrame, mapping: DataFrame, territories: DataFrame) -> DataFrame:
    """Distinct confirmed items, sample names and unlocked flag per territory.

    The latest sight of every (territory, item) is found by a map-side
    combinable aggregate; the three samples come from a per-territory top 3.
    """
    placed = with_territory(confirmed_only(scans), mapping).filter("territory_id is not null")
    items = placed.groupBy("territory_id", "item_id").agg(F.max(F.struct("ts", "scan_id")).alias("_seen"))
    tried = items.groupBy("territory_id").agg(F.count(F.lit(1)).alias("tried"))
    order = W.partitionBy("territory_id").orderBy(F.col("_seen").desc(), "item_id")
    samples = (items.withColumn("_n", F.row_number().over(order)).filter("_n <= 3")
               .groupBy("territory_id").agg(F.array_sort(F.collect_list(F.struct("_n", "item_id")))
                                            .alias("_s")))
    rows = territories.join(tried, "territory_id", "left").join(samples, "territory_id", "left")
    count = F.when(F.col("locked"), F.lit(0)).otherwise(F.coalesce("tried", F.lit(0))).cast("bigint")
    names = F.array_join(F.transform("_s", lambda s: s["item_id"]), ",")
    return rows.select("territory_id", "name", count.alias("tried"), "total_items",
                       (count > 0).alias("unlocked"), "locked",
                       F.coalesce(names, F.lit("")).alias("samples"))


def path_summary(scans: DataFrame, mapping: DataFrame, territories: DataFrame, points: DataFrame,
                 user: str = "user_id") -> DataFrame:
    """Per user: points, level, progress, territories opened and confirmed scans."""
    confirmed = with_territory(confirmed_only(scans), mapping)
    openable = territories.filter("not locked").select("territory_id", F.lit(True).alias("_open"))
    per_territory = (confirmed.groupBy(user, "territory_id").agg(F.count(F.lit(1)).alias("n"))
                     .join(openable, "territory_id", "left"))
    seen = per_territory.groupBy(user).agg(
        F.sum("n").alias("scans"), F.count_if(F.coalesce("_open", F.lit(False))).alias("opened"))
    total = openable.agg(F.count(F.lit(1))).scalar()
    level = sc.level_for(F.col("points"))
    rows = points.join(seen, user, "left").withColumn("_l", level)
    return rows.select(
        user, "points", F.col("_l.level").alias("level"), F.round("_l.progress", 6).alias("progress"),
        F.col("_l.points_from").alias("points_from"), F.col("_l.points_to").alias("points_to"),
        F.coalesce("opened", F.lit(0)).alias("opened"), F.coalesce("scans", F.lit(0)).alias("scans"),
    ).withColumn("territories", total)


def running_points(ledger: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "scan_id",
                   rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Running total per user with the level reached and whether the row raised it."""
    rows = running_sum(ledger, [user], [ts, tie], "delta", "running", rows_per_bucket)
    level = lambda c: sc.level_for(c)["level"]
    return (rows.withColumn("level", level(F.col("running")))
            .withColumn("level_up", F.col("level") > level(F.col("running") - F.col("delta"))))


def first_award(scans: DataFrame, user: str = "user_id") -> DataFrame:
    """First confirmed scan of every (user, item): the one that earns points."""
    found = confirmed_only(scans).filter("item_id is not null and item_id <> ''")
    rows = found.select(user, "item_id", "ts", "scan_id")
    return first_by(rows, [user, "item_id"], ["ts", "scan_id"]).withColumn("points", F.lit(fv.POINTS_SCAN))


def award_badges(scans: DataFrame, mapping: DataFrame, territories: DataFrame,
                 user: str = "user_id") -> DataFrame:
    """Badges every user has earned: first scan, territory tiers, territories and items counted."""
    confirmed = with_territory(confirmed_only(scans), mapping)
    pairs = confirmed.groupBy(user, "territory_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    open_dim = territories.filter("not locked and total_items > 0").select("territory_id", "total_items")
    scanned = pairs.groupBy(user, "territory_id").agg(F.count(F.lit(1)).alias("scanned"))
    progress = scanned.join(open_dim, "territory_id")
    needed = {"pioneer": F.lit(1), "legend": F.col("total_items")}
    for code, _, share in fv.TERRITORY_TIERS:
        needed.setdefault(code, F.ceil(F.col("total_items") * share))
    tiers = F.filter(F.array(*[
        F.when(F.col("scanned") >= needed[code], F.struct(
            F.concat(F.lit(code + "_"), "territory_id").alias("code"), F.lit(points).alias("points")))
        for code, points, _ in fv.TERRITORY_TIERS]), lambda b: b.isNotNull())
    by_territory = progress.select(user, F.explode(tiers).alias("b")).select(user, "b.*")

    items = (pairs.filter("item_id is not null and item_id <> ''").select(user, "item_id").distinct()
             .groupBy(user).agg(F.count(F.lit(1)).alias("items")))
    opened = progress.groupBy(user).agg(F.count(F.lit(1)).alias("opened"))
    openable = territories.filter("not locked").agg(F.count(F.lit(1))).scalar()
    users = (confirmed.select(user).distinct().join(items, user, "left").join(opened, user, "left")
             .withColumn("openable", openable).fillna(0, ["items", "opened"]))
    reached = {"first_scan": F.lit(True), "explorer_3": F.col("opened") >= 3,
               "explorer_5": F.col("opened") >= 5, "explorer_8": F.col("opened") >= F.col("openable"),
               "taster_10": F.col("items") >= 10, "taster_50": F.col("items") >= 50}
    general = F.filter(F.array(*[F.when(reached[code], F.struct(
        F.lit(code).alias("code"), F.lit(points).alias("points")))
        for code, points in fv.GENERAL_BADGES.items()]), lambda b: b.isNotNull())
    return users.select(user, F.explode(general).alias("b")).select(user, "b.*").unionByName(by_territory)


def points_total(awards: DataFrame, badges: DataFrame, user: str = "user_id") -> DataFrame:
    """Sum of scan and badge points; zero when a user has none."""
    entries = awards.select(user, F.col("points").alias("delta")).unionByName(
        badges.select(user, F.col("points").alias("delta")))
    return entries.groupBy(user).agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("points"))


def replay_collection(log: DataFrame, keys: list[str], ts: str, tie: str, op: str, amount: str,
                      rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Collection state after an ordered log of add, set, in_stock, consumed and remove changes.

    Every change maps a quantity q to max(floor, q + delta): adding n is
    max(0, q + n), putting in stock is max(1, q), setting n forgets q. Such maps
    compose to another one, so the final quantity is the greatest of
    floor + (sum of later deltas) over the changes. That needs a running sum
    and a maximum, both of which split a key with very many changes.
    """
    order = F.struct(ts, tie)
    at = log.withColumn("_at", order)
    removed = F.max(F.when(F.col(op) == "remove", F.col("_at")))
    cut = at.groupBy(*keys).agg(removed.alias("_cut"))
    alive = join_null_safe(at, cut, keys).filter((F.col("_cut").isNull() | (F.col("_at") > F.col("_cut")))
                                      & (F.col(op) != "remove"))
    starts = alive.groupBy(*keys).agg(
        F.min(F.when(F.col(op) == "add", F.col("_at"))).alias("_birth"),
        F.max(F.when(F.col(op) == "set", F.col("_at"))).alias("_set"))
    # Before its first add a key does not exist, and other changes do nothing.
    begin = F.greatest("_birth", "_set")
    changes = join_null_safe(alive, starts.filter("_birth is not null"), keys).filter(F.col("_at") >= begin)
    number = F.col(amount).cast("bigint")
    low = (F.when(F.col(op) == "set", F.greatest(number, F.lit(0))).when(F.col(op) == "add", F.lit(0))
           .when(F.col(op) == "in_stock", F.lit(1)))
    delta = F.when(F.col(op) == "add", number).otherwise(F.lit(0))
    # Kept, as they are counted and dealt out: neither makes the log and its joins anew.
    rows = keep(changes.select(*keys, ts, tie, op, low.cast("bigint").alias("_low"), delta.alias("_delta")))
    summed = running_sum(rows, keys, [ts, tie], "_delta", "_sum", rows_per_bucket)
    ends = summed.groupBy(*keys).agg(
        F.sum("_delta").alias("_total"), F.max(F.col("_low") - F.col("_sum")).alias("_best"),
        F.bool_or(F.col(op) == "set").alias("_fixed"), F.max_by(F.col(op), order).alias("_last"))
    from_floor = F.col("_best") + F.col("_total")
    quantity = F.when(F.col("_fixed"), from_floor).otherwise(F.greatest(from_floor, F.col("_total")))
    status = (F.when(F.col("_last") == "in_stock", "IN_STOCK").when(F.col("_last") == "consumed", "CONSUMED")
              .when(F.col("quantity") > 0, "IN_STOCK").otherwise("CONSUMED"))
    return ends.withColumn("quantity", quantity).select(*keys, "quantity", status.alias("status"))


def toggle_favorites(log: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """Favourites left after toggles: an odd number of them, with the last toggle's kind."""
    return (log.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                   F.max_by(F.col(kind), F.struct(*order)).alias(kind))
            .filter("_n % 2 = 1").drop("_n"))


def deadline_misses(jobs: DataFrame, key: str, started: Column, finished: Column, limit: int) -> DataFrame:
    """Jobs with no finish within `limit` of their start."""
    return jobs.groupBy(key).agg(F.min(F.when(started, F.col("ts"))).alias("started"),
                                 F.min(F.when(finished, F.col("ts"))).alias("finished")).filter(
        "started is not null").withColumn(
        "missed", F.coalesce(F.col("finished") - F.col("started") > limit, F.lit(True)))
