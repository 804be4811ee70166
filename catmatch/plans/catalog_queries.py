"""Catalogue loading, merging, inserting and searching over whole tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catmatch.functions import scalars as sc, vectors as vx
from catmatch.operators import catalog as cat, ranking as rk, visual as vs
from catmatch.plans.registry import query
from catmatch.sources.tables import shared_folder

IMAGE_BASE = "https://img.example.org/resize"
NESTED = """STRUCT<slug: STRING, title: STRING, winery: STRING>"""


@query("load_catalog", "S1", """
    SELECT slug, title, winery, layout FROM (
      SELECT slug, title, winery, (['items', 'wines', 'cards', 'single', 'array'])[p_partkey % 5 + 1] AS layout
      FROM cards)""")
def load_catalog(v):
    # The catalogue documents are derived from the parts, one JSON text per row.
    wrappers = F.array(*[F.lit(x) for x in ("items", "wines", "cards", "single", "array")])
    cards = v.cards.select("slug", "title", "winery", F.element_at(
        wrappers, (F.col("p_partkey") % 5 + 1).cast("int")).alias("layout"))
    body = F.to_json(F.struct("slug", "title", "winery"))
    text = (F.when(F.col("layout") == "single", body)
            .when(F.col("layout") == "array", F.concat(F.lit("["), body, F.lit("]")))
            .otherwise(F.concat(F.lit('{"'), F.col("layout"), F.lit('": ['), body, F.lit("]}"))))
    docs = cards.select("layout", text.alias("doc"))
    one = F.from_json("doc", "slug STRING, title STRING, winery STRING")
    wrapped = F.from_json("doc", f"items ARRAY<{NESTED}>, wines ARRAY<{NESTED}>, cards ARRAY<{NESTED}>")
    listed = F.from_json("doc", f"ARRAY<{NESTED}>")
    rows = (F.when(F.substring("doc", 1, 1) == "[", listed)
            .otherwise(F.coalesce(wrapped["items"], wrapped["wines"], wrapped["cards"], F.array(one))))
    return docs.select("layout", F.explode(rows).alias("c")).select("c.*", "layout")


def written(v, rows, name: str, **options) -> str:
    """The path of text rows written to a new folder that all executors see; it stays there."""
    path = f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.options(**options).text(path)
    return path


@query("load_card_lines", "S1", "SELECT slug, title, winery, category, region FROM cards WHERE p_partkey % 13 <> 0")
def load_card_lines(v):
    """Cards written as JSON lines, some without a slug, and loaded."""
    slug = F.when(F.col("p_partkey") % 13 != 0, F.col("slug")).alias("slug")
    lines = v.cards.select(F.to_json(F.struct(slug, "title", "winery", "category", "region")).alias("value"))
    return cat.load_catalog(v.spark, written(v, lines, "cards")).select("slug", "title", "winery", "category", "region")


@query("load_card_documents", "S1", "SELECT slug, title, winery FROM cards")
def load_card_documents(v):
    """Cards written as documents of up to 1,000: wrapped in one of three ways, a bare array, or a single object."""
    rows = v.cards.select(F.expr("p_partkey div 1000").alias("part"), (F.col("p_partkey") % 1000 == 999).alias("single"), F.struct("slug", "title", "winery").alias("card"))
    groups = rows.groupBy("part", "single").agg(F.collect_list("card").alias("cards"))  # 999 cards or one
    wrapped = F.concat(F.lit('{"'), F.get(F.array(F.lit("items"), F.lit("wines"), F.lit("cards")), (F.col("part") % 4 - 1).cast("int")),
                       F.lit('": '), F.to_json("cards"), F.lit("}"))
    text = F.when(F.col("single"), F.to_json(F.col("cards")[0])).when(F.col("part") % 4 == 0, F.to_json("cards")).otherwise(wrapped)
    path = written(v, groups.select(text.alias("value")), "documents", maxRecordsPerFile=1)
    return cat.load_catalog(v.spark, path, "document").select("slug", "title", "winery")


@query("snapshot_version", "S3", "SELECT sha256(text || chr(10)) AS sha256 FROM benchmark")
def snapshot_version(v):
    """The hash of every file of a snapshot that holds one passage each."""
    path = written(v, v.benchmark.select(F.col("text").alias("value")), "snapshot", maxRecordsPerFile=1)
    return cat.snapshot_version(v.spark, path).select("sha256")


@query("assert_unique", "S2", """SELECT slug, count(*) AS n FROM parts_dup GROUP BY slug HAVING count(*) > 1""")
def assert_unique(v):
    return cat.duplicate_keys(v.parts_dup, "slug")


VERSION_SQL = "sha256('snapshot-' || {n})"


@query("compatible_results", "S3", """
    SELECT query_id, slug, catalog_sha256 FROM (SELECT query_id, slug, sha256('snapshot-' || (query_id % 5)) AS catalog_sha256
    FROM candidates) WHERE catalog_sha256 IN (sha256('snapshot-0'), sha256('snapshot-2'), sha256('snapshot-3'))""")
def compatible_results(v):
    version = lambda n: F.sha2(F.concat(F.lit("snapshot-"), n), 256)
    results = v.candidates.select("query_id", "slug",
                                  version(F.col("query_id") % 5).alias("catalog_sha256"))
    current = version(F.lit("0"))
    manifest = v.region.filter("r_regionkey = 0").select(
        current.alias("catalog_sha256"),
        F.array(version(F.lit("2")), version(F.lit("3"))).alias("compatible"))
    return cat.compatible_results(results, manifest, current)


@query("validate_vectors", "S4", """
    SELECT vec_id, len(embedding) = 64 AS dim_ok,
      len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite,
      abs(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) <= 1e-4 AS unit,
      ('b' || label) IN (SELECT slug FROM bench_cards) AS mapped FROM embeddings""")
def validate_vectors(v):
    vector = F.col("embedding")
    known = v.bench_cards.select("slug").distinct().withColumn("_known", F.lit(True))
    rows = v.embeddings.withColumn("slug", F.concat(F.lit("b"), "label")).join(known, "slug", "left")
    return rows.select(
        "vec_id", (F.size(vector) == 64).alias("dim_ok"), vx.all_finite(vector).alias("finite"),
        (F.abs(vx.dot(vector, vector) - 1) <= 1e-4).alias("unit"),
        F.coalesce("_known", F.lit(False)).alias("mapped"))


@query("invalid_views", "S4", """
    SELECT vec_id AS view_id FROM embeddings WHERE vec_id % 17 = 0 OR vec_id % 19 = 0 OR vec_id % 23 = 0 OR vec_id % 29 = 0
      OR 'b' || label NOT IN (SELECT slug FROM bench_cards)""")
def invalid_views(v):
    """Views of which some are zero, cut, mapped to an unknown card, or to none."""
    key, vector = F.col("vec_id"), F.col("embedding")
    broken = F.when(key % 17 == 0, F.transform(vector, lambda x: x * 0)).when(key % 19 == 0, F.slice(vector, 1, 60)).otherwise(vector)
    own = F.concat(F.lit("b"), "label")
    slugs = F.when(key % 23 == 0, F.array(own, F.lit("nobody"))).when(key % 29 == 0, F.array().cast("array<string>")).otherwise(F.array(own))
    return vs.invalid_views(v.embeddings.select(key.alias("view_id"), broken.alias("vector"), slugs.alias("slugs")), v.bench_cards, 64)


@query("normalize_vectors", "S5", """
    SELECT vec_id, round(list_dot_product(u, u), 6) AS norm2, round(u[1], 6) AS first, round(u[64], 6) AS last
    FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (
      SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 3)) AS e FROM embeddings))""")
def normalize_vectors(v):
    scaled = F.transform(vx.as_doubles(F.col("embedding")), lambda x: x * (1 + F.col("vec_id") % 3))
    unit = v.embeddings.select("vec_id", vx.normalize(scaled).alias("u"))
    return unit.select("vec_id", F.round(vx.dot(F.col("u"), F.col("u")), 6).alias("norm2"),
                       F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


MERGED = {"merged": """SELECT l.slug, coalesce(d.title, l.title) AS title,
    coalesce(d.category, l.category) AS category, l.manufacturer, coalesce(d.region, l.region) AS region,
    l.rating, l.image, d.alcohol, d.grapes, d.vintage
    FROM feed_list l LEFT JOIN feed_detail d ON l.slug = d.slug"""}


@query("merge_list_detail", "S6", """SELECT slug, title, category, region, rating, alcohol FROM merged""", MERGED)
def merge_list_detail(v):
    merged = cat.merge_list_detail(v.feed_list, v.feed_detail)
    return merged.select("slug", "title", "category", "region", "rating", "alcohol")


@query("merge_null_overrides", "S6", """
    SELECT l.slug, CASE WHEN d.slug IS NULL THEN l.title ELSE d.title END AS title,
      CASE WHEN d.slug IS NULL THEN l.category ELSE d.category END AS category
    FROM feed_list l LEFT JOIN feed_detail d ON l.slug = d.slug""")
def merge_null_overrides(v):
    merged = cat.merge_list_detail(v.feed_list, v.feed_detail, null_overrides=True)
    return merged.select("slug", "title", "category")


@query("insert_if_absent", "S7 J10", """
    SELECT slug, count(*)::BIGINT AS rows, bool_or(known) AS skipped FROM (
      SELECT f.slug, k.slug IS NOT NULL AS known FROM (SELECT slug FROM feed_list UNION ALL
        SELECT slug FROM feed_detail) f LEFT JOIN known k ON f.slug = k.slug) GROUP BY slug""")
def insert_if_absent(v):
    batch = v.feed_list.select("slug").unionByName(v.feed_detail.select("slug"))
    return cat.insert_if_absent(v.known, batch, "slug", ["slug"])


@query("new_rows", "S7 J10", """SELECT slug, min(title) AS title FROM (SELECT slug, coalesce(title, slug) AS title
    FROM feed_list) WHERE slug NOT IN (SELECT slug FROM known) GROUP BY slug""")
def new_rows(v):
    batch = v.feed_list.select("slug", F.coalesce("title", "slug").alias("title"))
    return cat.new_rows(v.known, batch, "slug", ["title"])


@query("import_stats", "S8", """
    SELECT ceil(count(*) / 20.0)::BIGINT AS pages,
      count(*) FILTER (k.slug IS NULL AND f.slug <> '') AS upserted,
      count(*) FILTER (k.slug IS NULL AND f.slug <> '' AND image IS NOT NULL) AS images,
      count(*) FILTER (k.slug IS NOT NULL) AS skipped, count(*) FILTER (f.slug = '') AS failed
    FROM (SELECT CASE WHEN p_partkey % 13 = 0 THEN '' ELSE slug END AS slug, image FROM feed_list) f
    LEFT JOIN known k ON f.slug = k.slug""")
def import_stats(v):
    batch = v.feed_list.withColumn("slug", F.when(F.col("p_partkey") % 13 == 0, "").otherwise(F.col("slug")))
    return cat.import_stats(batch, v.known)


@query("set_if_null", "S9", """
    SELECT k.slug, coalesce(k.image_key, 'items/' || k.slug || '.png') AS image_key FROM known k
    JOIN feed_list f USING (slug) WHERE image IS NOT NULL
    UNION ALL SELECT k.slug, k.image_key FROM known k JOIN feed_list f USING (slug) WHERE image IS NULL""")
def set_if_null(v):
    updates = v.feed_list.filter("image IS NOT NULL").select(
        "slug", sc.image_key(F.col("slug"), F.col("image")).alias("image_key"))
    return cat.set_if_null(v.known, updates, "slug", "image_key").select("slug", "image_key")


@query("upsert_latest", "S10", """
    SELECT user_id, item_id, scan_id, ts, status FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, item_id ORDER BY ts DESC, scan_id DESC) AS n FROM scan_log) WHERE n = 1""")
def upsert_latest(v):
    log = v.scan_log.select("user_id", "item_id", "scan_id", "ts", "status")
    return rk.latest_by(log, ["user_id", "item_id"], ["ts", "scan_id"])


@query("build_search_documents", "S11", """
    SELECT slug, 'query: Цвет: ' || split_part(title, ' ', 1) || chr(10) || 'Сладость: ' || coalesce(sweetness, '')
      || chr(10) || 'Виноград: ' || grapes || chr(10) || 'Описание: '
      || CASE WHEN p_partkey % 4 = 1 THEN 'from ' || region ELSE title END
      || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Сочетания с едой: ' || category || ', ' || winery ELSE '' END
      || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Температура подачи: ' || size || '–' || (size + 2) || ' °C' ELSE '' END
      AS text FROM cards""")
def build_search_documents(v):
    cards, key = v.cards, F.col("p_partkey")
    base = cards.select("slug", F.split("title", " ")[0].alias("color"), "sweetness", "grapes",
                        F.col("title").alias("description"))
    none = F.lit(None)
    extra = cards.select(
        "slug", F.when(key % 4 == 1, F.concat(F.lit("from "), "region")).alias("extra_description"),
        F.when(key % 2 == 0, F.array("category", "winery")).alias("food_pairing"),
        F.when(key % 3 == 0, F.col("size")).otherwise(none).alias("temp_min"),
        F.when(key % 3 == 0, F.col("size") + 2).otherwise(none).alias("temp_max"))
    return cat.build_search_documents(base, extra)


@query("token_budget", "S12", r"""
    SELECT count(*) AS documents, count(*) FILTER (len(regexp_extract_all(text, '\S+')) > 512) AS truncated
    FROM documents""")
def token_budget(v):
    return cat.over_budget(v.documents)


@query("explode_result", "S13", """
    SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, NULL::VARCHAR AS unknown_key FROM events""")
def explode_result(v):
    blob = F.from_json("props", "k BIGINT, unknown_key STRING")
    return v.events.select("event_id", blob.alias("b")).select("event_id", "b.*")


@query("map_card", "P1", f"""
    SELECT slug, coalesce(nullif(trim(title), ''), slug) AS name,
      CASE WHEN try_cast(vintage AS INT) BETWEEN 1900 AND 2100 THEN try_cast(vintage AS INT) END::DOUBLE AS vintage,
      rating, category, array_to_string(grapes, ' / ') AS grapes, coalesce(region, 'Home') AS region,
      CASE WHEN alcohol > 30 THEN alcohol / 10 ELSE alcohol END AS alcohol_percentage,
      CASE WHEN image IS NOT NULL THEN '{IMAGE_BASE}/' || image END AS image_url, manufacturer AS winery
    FROM merged""", MERGED)
def map_card(v):
    merged = cat.merge_list_detail(v.feed_list, v.feed_detail)
    cards = cat.map_card(merged, "Home", IMAGE_BASE, "Home", "HM")
    return cards.select("slug", "name", F.col("vintage").cast("double").alias("vintage"), "rating",
                        "category", "grapes", F.col("region.name").alias("region"),
                        "alcohol_percentage", "image_url", F.col("winery.name").alias("winery"))


@query("catalog_refresh", "Q17", """
    SELECT m.slug, coalesce(nullif(trim(m.title), ''), m.slug) AS name, rating,
      CASE WHEN alcohol > 30 THEN alcohol / 10 ELSE alcohol END AS alcohol_percentage
    FROM merged m WHERE m.slug NOT IN (SELECT slug FROM known)""", MERGED)
def catalog_refresh(v):
    fresh = v.feed_list.join(v.known.select("slug"), "slug", "left_anti")
    merged = cat.merge_list_detail(fresh, v.feed_detail)
    cards = cat.map_card(merged, "Home", IMAGE_BASE, "Home", "HM")
    inserted = rk.first_by(cards.select("slug", "name", "rating", "alcohol_percentage"), ["slug"], ["name"])
    return inserted


@query("get_by_id", "F3", """
    SELECT coalesce(k.slug, f.slug) AS slug, CASE WHEN k.slug IS NOT NULL THEN k.name ELSE f.title END AS name,
      CASE WHEN k.slug IS NOT NULL THEN 'store' ELSE 'file' END AS source
    FROM known k FULL JOIN feed_list f ON k.slug = f.slug""")
def get_by_id(v):
    file = v.feed_list.select("slug", F.col("title").alias("name"))
    return cat.get_by_id(v.known.select("slug", "name"), file)


SEARCH_ORDER = ["title", "slug"]


@query("search_file", "F1", """
    SELECT slug, title FROM cards WHERE contains(lower(concat_ws(' ', slug, title, winery, region, grapes, category)), 'rod large')""")
def search_file(v):
    return cat.search_file(v.cards, " ROD Large ").select("slug", "title")


@query("search_file_all", "F1", "SELECT slug, title FROM cards")
def search_file_all(v):
    return cat.search_file(v.cards, "  ").select("slug", "title")


@query("search_db", "F2", r"""
    SELECT slug, title FROM cards WHERE slug ILIKE '%nation\_1%' ESCAPE '\' OR title ILIKE '%nation\_1%' ESCAPE '\'
    OR winery ILIKE '%nation\_1%' ESCAPE '\' OR region ILIKE '%nation\_1%' ESCAPE '\'
    OR category ILIKE '%nation\_1%' ESCAPE '\' OR grapes ILIKE '%nation\_1%' ESCAPE '\'""")
def search_db(v):
    fields = ["slug", "title", "category", "grapes", "winery", "region"]
    return cat.search_db(v.cards, "Nation_1", fields).select("slug", "title")


@query("search_many", "F1 F2", """
    WITH needles AS (SELECT p_partkey AS needle_id, trim(CASE WHEN p_partkey % 11 = 0 THEN 'P' || p_partkey // 10
        ELSE upper(substr(p_name || ' ' || p_type, p_partkey % 6 + 1, p_partkey % 9)) END) AS needle FROM part),
      texts AS (SELECT slug, lower(concat_ws(' ', slug, title, winery, region, grapes, category)) AS searched FROM cards)
    SELECT needle_id, slug, position FROM needles JOIN (SELECT needle, slug, row_number() OVER (PARTITION BY needle ORDER BY slug) AS position
      FROM (SELECT DISTINCT needle FROM needles) JOIN texts ON contains(searched, lower(needle))) USING (needle) WHERE position <= 5""")
def search_many(v):
    """A needle of none to eight characters for every card."""
    key = F.col("p_partkey")
    cut = F.upper(F.substring(F.concat_ws(" ", "p_name", "p_type"), (key % 6 + 1).cast("int"), (key % 9).cast("int")))
    needles = v.part.select(key.alias("needle_id"), F.when(key % 11 == 0, F.concat(F.lit("P"), F.expr("p_partkey div 10"))).otherwise(cut).alias("needle"))
    return cat.search_many(cat.substring_index(v.cards), needles, 5)


@query("search_page", "O1", """
    SELECT slug, title, position, total, 40 + count(*) OVER () < total AS has_more FROM (
      SELECT slug, title, row_number() OVER (ORDER BY title, slug) AS position, count(*) OVER () AS total
      FROM cards WHERE title ILIKE '%red%' OR category ILIKE '%red%') WHERE position BETWEEN 41 AND 60""")
def search_page(v):
    found = cat.search_db(v.cards, "red", ["title", "category"]).select("slug", "title")
    return rk.page(found, SEARCH_ORDER, 3, 20)


@query("region_to_territory", "P14 J9", """
    SELECT DISTINCT l.region, t.territory_id FROM scan_log l LEFT JOIN region_territory t USING (region)""")
def region_to_territory(v):
    territories = v.territories.withColumn("registry_order", F.substring("territory_id", 2, 9).cast("int"))
    regions = v.scan_log.select("region").distinct()
    return regions.join(cat.territory_of_region(regions, territories), "region", "left")


@query("attribute_aliases", "P14", """
    SELECT slug, CASE WHEN contains(lower(title), 'large') THEN 'big' WHEN contains(lower(title), 'ring') THEN 'round'
      WHEN contains(lower(title), 'old') THEN 'aged' END AS group_id FROM cards""")
def attribute_aliases(v):
    aliases = [("old", "aged"), ("large", "big"), ("ring", "round")]
    return v.cards.select("slug", sc.region_to_territory(F.col("title"), aliases).alias("group_id"))


@query("snapshot_digest", "S3", """
    SELECT item_id, sha256(text) AS sha256 FROM benchmark""")
def snapshot_digest(v):
    return v.benchmark.select("item_id", F.sha2("text", 256).alias("sha256"))
