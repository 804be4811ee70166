"""Normalisation, tagging, fuzzy matching and text retrieval queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from catmatch import fixed_values as fv
from catmatch.functions import scalars as sc, text as tx
from catmatch.operators import fuzzy as fz, tagging as tg, text_search as ts
from catmatch.plans.oracle_views import ALIASES, folded, sql_in, tokens, usable
from catmatch.plans.registry import query
from catmatch.sources.tables import lookup

WORDS_SQL = r"regexp_extract_all({t}, '[\p{{L}}\p{{N}}]+')"


def words_sql(text: str) -> str:
    return WORDS_SQL.format(t=text)


# ------------------------------------------------------------- normalisation
@query("normalize_phrase", "T1", f"""
    SELECT doc_id, array_to_string({words_sql("strip_accents(" + folded('text') + ")")}, ' ') AS phrase FROM documents""")
def normalize_phrase(v):
    return v.documents.select("doc_id", tx.normalize_phrase(F.col("text")).alias("phrase"))


@query("raw_words", "T2", f"""
    SELECT doc_id, array_to_string({words_sql(folded('text'))}, ' ') AS words FROM documents""")
def raw_words(v):
    return v.documents.select("doc_id", F.array_join(tx.raw_words(F.col("text")), " ").alias("words"))


@query("tokens", "T3 T4", f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents")
def tokens_query(v):
    return v.documents.select("doc_id", F.array_join(tx.tokens("text"), " ").alias("tokens"))


LOOKALIKE = f"replace(strip_accents(translate(w, 'bchpy', 'vsnru')), 'x', 'kh')"
GLYPH = ("replace(replace(replace(strip_accents(translate(replace(regexp_replace(w, '(?:io|1o|10)', '@', 'g'), '4', '#'), "
         "'630bchpy', 'bzovsnru')), 'x', 'kh'), '#', 'ch'), '@', 'yu')")


def aliased(expr: str) -> str:
    return f"coalesce({ALIASES}[{expr}], {expr})"


WORD_VIEWS = {
    "doc_words": f"SELECT DISTINCT unnest({words_sql(folded('text'))}) AS w FROM documents",
    "readings": f"""SELECT w AS raw, 'direct' AS method, 1.0::DOUBLE AS prior, {aliased('strip_accents(w)')} AS term FROM @source
      UNION ALL SELECT w, 'lookalike', 0.96::DOUBLE, {aliased(LOOKALIKE)} FROM @source
      UNION ALL SELECT w, 'glyph', 0.9::DOUBLE, {aliased(GLYPH)} FROM @source""",
    "variants": f"""SELECT raw, term, method, prior FROM (SELECT *, row_number() OVER (PARTITION BY raw, term
      ORDER BY prior DESC) AS n FROM readings) WHERE n = 1 AND {usable('term')}""",
}


def word_views(source: str) -> dict[str, str]:
    return {**WORD_VIEWS, "readings": WORD_VIEWS["readings"].replace("@source", source)}


@query("word_variants", "T5", "SELECT raw, term, method, prior FROM variants", word_views("doc_words"))
def word_variants(v):
    words = v.documents.select(F.explode(tx.raw_words(F.col("text"))).alias("word")).distinct()
    return fz.variants_of(words).select("raw", F.col("word").alias("term"), "method", "prior")


GLYPH_WORDS = ["the", "of", "und", "une", "les"]


@query("damerau_levenshtein", "J5", "SELECT p_partkey, damerau_levenshtein(p_name, lower(p_type)) AS distance FROM part")
def damerau_levenshtein(v):
    from catmatch.functions.distance import damerau_levenshtein as distance
    return v.part.select("p_partkey", distance(F.col("p_name"), F.lower("p_type")).cast("bigint").alias("distance"))


@query("decode_attribute_glyphs", "T6", f"""
    SELECT doc_id, array_to_string(list_transform(string_split(array_to_string({words_sql("strip_accents(" + folded('text') + ")")}, ' '), ' '),
      lambda w: CASE WHEN translate(w, 'aio', 'eue') IN {sql_in(GLYPH_WORDS)} THEN translate(w, 'aio', 'eue') ELSE w END), ' ') AS decoded FROM documents""")
def decode_attribute_glyphs(v):
    return v.documents.select("doc_id", tx.decode_attribute_glyphs(
        F.col("text"), GLYPH_WORDS, "aio", "eue").alias("decoded"))


# ------------------------------------------------------------------- tagging
TAGS = {"Red": ["red"], "Red ring": ["red ring"], "Small ring": ["ring small"], "Blue": ["blue"], "Rod": ["rod", "gear large"]}


@query("tag_values", "T7", """
    SELECT query_id, line_no, unnest(list_filter([
      CASE WHEN contains(p, ' ring small ') THEN 'Small ring' WHEN contains(p, ' red ring ') THEN 'Red ring' END,
      CASE WHEN contains(p, ' red ') AND NOT (contains(p, ' red ring ') AND NOT contains(p, ' ring small ')) THEN 'Red' END,
      CASE WHEN contains(p, ' blue ') THEN 'Blue' END,
      CASE WHEN contains(p, ' rod ') OR contains(p, ' gear large ') THEN 'Rod' END], lambda x: x IS NOT NULL)) AS value
    FROM (SELECT query_id, line_no, ' ' || lower(text) || ' ' AS p FROM part_lines)""")
def tag_values(v):
    vocabulary = tg.phrase_table(v.spark, "tag", {k: [p for p in s if p != k.lower()] for k, s in TAGS.items()})
    # "Small ring" is only written "ring small" in the lines.
    vocabulary = vocabulary.filter("phrase <> 'small ring'")
    return tg.find_values(v.part_lines, ["query_id", "line_no"], "text", vocabulary).drop("kind")


@query("tag_status", "T8", """
    SELECT query_id, CASE WHEN count(DISTINCT c) = 0 THEN 'missing' WHEN count(DISTINCT c) = 1 THEN 'read' ELSE 'ambiguous' END AS status,
      CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS value FROM (SELECT query_id,
      CASE WHEN contains(text, 'red') THEN 'red' WHEN contains(text, 'blue') THEN 'blue' END AS c FROM part_lines) GROUP BY query_id""")
def tag_status(v):
    color = F.when(F.contains("text", F.lit("red")), "red").when(F.contains("text", F.lit("blue")), "blue")
    values = v.part_lines.groupBy("query_id").agg(F.array_sort(F.collect_set(color)).alias("v"))
    return values.select("query_id", sc.tag_status(F.col("v")).alias("status"), sc.single(F.col("v")).alias("value"))


@query("sequential_tags", "T9", """
    SELECT query_id, value, max(confidence) AS confidence FROM (SELECT query_id, confidence, unnest(list_filter([
      CASE WHEN regexp_matches(t, '\\bold +gear\\b') THEN 'Old gear' END,
      CASE WHEN regexp_matches(regexp_replace(t, '\\bold +gear\\b', ' ', 'g'), '\\b(old|new)\\b') THEN 'Age' END,
      CASE WHEN regexp_matches(regexp_replace(t, '\\bold +gear\\b', ' ', 'g'), '\\bgear\\b') THEN 'Gear' END],
      lambda x: x IS NOT NULL)) AS value FROM (SELECT *, lower(text) AS t FROM part_lines
      WHERE on_target AND confidence BETWEEN 0.7 AND 1)) GROUP BY query_id, value""".replace("\\\\b", "\\b"))
def sequential_tags(v):
    patterns = [("Old gear", r"old +gear"), ("Age", r"old|new"), ("Gear", r"gear")]
    return tg.sequential_tags(v.part_lines, patterns, 0.7)


SWEET_STATUS = """SELECT query_id, CASE WHEN count(*) = 1 THEN min(value) END AS value, CASE WHEN count(*) = 1 THEN 'read' ELSE 'ambiguous' END AS status
    FROM (SELECT DISTINCT query_id, split_part(text, ' ', 3) AS value FROM part_lines WHERE on_target AND confidence >= 0.7) GROUP BY query_id"""


@query("single_reading", "T8 T9", SWEET_STATUS)
def single_reading(v):
    patterns = [(t, t.lower()) for t in ("MEDIUM", "ECONOMY", "STANDARD", "PROMO")]
    # LARGE and SMALL are also first words of a name: read them at the end of the line only.
    patterns += [(t, t.lower() + "$") for t in ("LARGE", "SMALL")]
    tags = tg.sequential_tags(v.part_lines, patterns, 0.7)
    return tg.single_reading(tags).select("query_id", "value", "status")


@query("reliable_lines", "T12", "SELECT query_id, line_no FROM obs WHERE on_target AND confidence BETWEEN 0.8 AND 1")
def reliable_lines(v):
    return tg.reliable_lines(v.obs, 0.8).select("query_id", "line_no")


def part_vocabulary(v):
    colors = tg.phrase_table(v.spark, "color", {"red": ["ring red"], "blue": []})
    sweet = tg.phrase_table(v.spark, "sweetness", {t: [] for t in ("MEDIUM", "ECONOMY", "STANDARD", "PROMO")})
    grapes = tg.phrases_of(v.cards.select(F.col("grapes").alias("value")).distinct(), "grapes")
    special = v.spark.createDataFrame([("grapes", "red anvil", "red anvil", 5)], "kind string, value string, phrase string, phrase_order int")
    return colors.unionByName(sweet).unionByName(grapes).unionByName(special)


@query("mask_then_tag", "T10", """
    SELECT query_id, line_no, kind, value FROM (
      SELECT query_id, line_no, 'color' AS kind, split_part(text, ' ', 1) AS value FROM part_lines
        WHERE split_part(text, ' ', 1) IN ('red', 'blue') AND text NOT LIKE 'red anvil%'
      UNION ALL SELECT query_id, line_no, 'grapes', CASE WHEN text LIKE 'red anvil%' THEN 'red anvil' ELSE split_part(text, ' ', 2) END FROM part_lines
      UNION ALL SELECT query_id, line_no, 'sweetness', split_part(text, ' ', 3) FROM part_lines
        WHERE split_part(text, ' ', 3) IN ('MEDIUM', 'ECONOMY', 'STANDARD', 'PROMO'))""")
def mask_then_tag(v):
    return tg.line_tags(v.part_lines, part_vocabulary(v))


@query("observed_profile", "Q10 T12", """
    WITH tags AS (SELECT query_id, line_no, 'color' AS attribute, split_part(text, ' ', 1) AS value FROM part_lines
        WHERE on_target AND confidence >= 0.8 AND split_part(text, ' ', 1) IN ('red', 'blue') AND text NOT LIKE 'red anvil%'
      UNION ALL SELECT query_id, line_no, 'grapes', CASE WHEN text LIKE 'red anvil%' THEN 'red anvil' ELSE split_part(text, ' ', 2) END
        FROM part_lines WHERE on_target AND confidence >= 0.8
      UNION ALL SELECT query_id, line_no, 'sweetness', split_part(text, ' ', 3) FROM part_lines WHERE on_target AND confidence >= 0.8
        AND split_part(text, ' ', 3) IN ('MEDIUM', 'ECONOMY', 'STANDARD', 'PROMO')),
    asked AS (SELECT DISTINCT query_id, unnest(['color', 'sweetness', 'grapes', 'producer']) AS attribute FROM part_lines),
    found AS (SELECT query_id, attribute, list_sort(list(DISTINCT value)) AS v FROM tags GROUP BY query_id, attribute)
    SELECT query_id, attribute, CASE WHEN v IS NULL THEN 'missing' WHEN attribute = 'grapes' OR len(v) = 1 THEN 'read' ELSE 'ambiguous' END AS status,
      CASE WHEN v IS NOT NULL AND (attribute = 'grapes' OR len(v) = 1) THEN array_to_string(v, ',') ELSE '' END AS value
    FROM asked LEFT JOIN found USING (query_id, attribute)""".replace("AS value\n    FROM asked", "AS found_values\n    FROM asked"))
def observed_profile(v):
    profile = tg.observed_profile(v.part_lines, part_vocabulary(v))
    return profile.select("query_id", "attribute", "status", F.coalesce(
        F.array_join("values", ","), F.lit("")).alias("found_values"))


@query("attribute_precedence", "P16", """
    SELECT slug, CASE WHEN len(h) = 1 THEN h[1] END AS sweetness, source FROM (SELECT slug,
      CASE WHEN len(r) > 0 THEN r WHEN len(m) > 0 THEN m WHEN len(t) > 0 THEN t ELSE [] END AS h,
      CASE WHEN len(r) > 0 THEN 'reviewed' WHEN len(m) > 0 THEN 'metadata' WHEN len(t) > 0 THEN 'title' END AS source FROM (
      SELECT slug, CASE WHEN review_status IN ('confirmed', 'applied') AND review_sweetness IS NOT NULL THEN [review_sweetness] ELSE [] END AS r,
        CASE WHEN sweetness IS NOT NULL THEN [sweetness] ELSE [] END AS m,
        list_filter(['SMALL', 'LARGE', 'OLD', 'ROD'], lambda x: list_contains(string_split(upper(title), ' '), x)) AS t FROM cards))""")
def attribute_precedence(v):
    from catmatch.operators.recommend import attribute_precedence as op
    values = ["SMALL", "LARGE", "PROMO", "OLD", "ROD"]
    return op(v.cards, {x: [] for x in values})


OBSERVED = {"grapes": {"ring": r"\bring\b", "gizmo": r"giz+mo"}, "colors": {"red": r"\bred\b", "old": r"\bold\b"}}


@query("observed_lines", "P20", """
    WITH best AS (SELECT query_id, arg_min(text, [-confidence, line_no]) AS text, max(confidence) AS confidence FROM part_lines
      WHERE on_target AND confidence >= 0.65 GROUP BY query_id, lower(text))
    SELECT query_id, 'colors' AS field, split_part(lower(text), ' ', 1) AS value, text, confidence FROM best WHERE split_part(lower(text), ' ', 1) IN ('red', 'old')
    UNION ALL SELECT query_id, 'grapes', split_part(lower(text), ' ', 2), text, confidence FROM best WHERE split_part(lower(text), ' ', 2) IN ('ring', 'gizmo')""")
def observed_lines(v):
    return tg.observed_lines(v.part_lines, 2026, **OBSERVED)


@query("observed_fields", "P20", """
    WITH best AS (SELECT query_id, lower(text) AS t, max(confidence) AS confidence FROM part_lines WHERE on_target AND confidence >= 0.65 GROUP BY ALL)
    SELECT query_id, 'colors' AS field, c AS value, count(*) AS lines, max(confidence) AS confidence FROM (
      SELECT query_id, confidence, split_part(t, ' ', 1) AS c FROM best) WHERE c IN ('red', 'old') GROUP BY ALL
    UNION ALL SELECT query_id, 'grapes', g, count(*), max(confidence) FROM (
      SELECT query_id, confidence, split_part(t, ' ', 2) AS g FROM best) WHERE g IN ('ring', 'gizmo') GROUP BY ALL""")
def observed_fields(v):
    grapes = {"ring": r"\bring\b", "gizmo": r"giz+mo"}
    colors = {"red": r"\bred\b", "old": r"\bold\b"}
    return tg.observed_fields(v.part_lines, 2026, grapes, colors)


@query("grape_vocabulary", "A24", """
    SELECT DISTINCT trim(g) AS value FROM (SELECT unnest(string_split(grapes || ', ' || category || ' и ' || grapes || ', ' || winery, ',')) AS g FROM cards)
    WHERE NOT contains(g, ' и ') AND trim(g) <> '' AND lower(trim(g)) NOT IN ('ring', 'bolt')""")
def grape_vocabulary(v):
    cards = v.cards.select(F.concat("grapes", F.lit(", "), "category", F.lit(" и "), "grapes", F.lit(", "), "winery").alias("g"))
    return tg.grape_values(cards, "g", ["Ring", "BOLT"])


# ------------------------------------------------------- catalogue statistics
def _field_rows(views: str = "bench_cards") -> str:
    parts = [f"SELECT slug, '{f}' AS field, {w}::DOUBLE AS w, unnest({tokens(f)}) AS term FROM {views}"
             for f, w in fv.FIELD_WEIGHTS.items() if f in ("title", "winery", "grapes", "category", "region")]
    return " UNION ALL ".join(parts)


INDEX_VIEWS = {
    "field_rows": _field_rows(),
    "doc_terms": "SELECT slug, term, arg_max(field, w) AS field, max(w) AS w FROM field_rows GROUP BY slug, term",
    "vocab": f"""SELECT term, count(*) AS df, least(5.0, 1 + ln(((SELECT count(*) FROM bench_cards) + 1) / (count(*) + 1)::DOUBLE)) AS idf
      FROM doc_terms GROUP BY term""",
    "winery_owner": f"SELECT term, count(DISTINCT winery) AS owners FROM (SELECT winery, unnest({tokens('winery')}) AS term FROM bench_cards) GROUP BY term",
    "grape_term": f"""SELECT DISTINCT term FROM field_rows WHERE field = 'grapes' AND length(term) >= 5
      AND term NOT IN {sql_in(fv.COLOR_TERMS + fv.SWEETNESS_TERMS)}""",
}


@query("idf", "A1", """
    SELECT term, df, round(least(5.0, 1 + ln(((SELECT count(*) FROM benchmark) + 1) / (df + 1)::DOUBLE)), 6) AS idf FROM (
      SELECT term, count(DISTINCT item_id) AS df FROM bench_terms GROUP BY term)""")
def idf(v):
    total = v.benchmark.agg(F.count(F.lit(1))).scalar()
    counts = v.bench_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.select("term", "df", F.round(ts.idf(total, F.col("df")), 6).alias("idf"))


@query("best_field_per_term", "A2", "SELECT slug, term, field, w AS field_weight FROM doc_terms", INDEX_VIEWS)
def best_field_per_term(v):
    return ts.best_fields(ts.with_text_fields(v.bench_cards), "slug")


@query("mean_title_length", "A3", f"""
    SELECT round(avg(greatest(1, len(list_distinct({tokens('title')})))), 6) AS mean_length FROM cards""")
def mean_title_length(v):
    size = F.greatest(F.size(F.array_distinct(tx.tokens("title"))), F.lit(1))
    return v.cards.agg(F.round(F.avg(size), 6).alias("mean_length"))


@query("unique_owner", "A4", """
    SELECT term, min(item_id) AS owner FROM bench_terms WHERE length(term) >= 4 GROUP BY term HAVING count(DISTINCT item_id) = 1""")
def unique_owner(v):
    terms = v.bench_terms.filter(F.length("term") >= 4).distinct()
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("owner")).filter(
        "n = 1").select("term", "owner")


def _phrase(text: str) -> str:
    return f"array_to_string({words_sql('strip_accents(' + folded(text) + ')')}, ' ')"


@query("producer_aliases", "A4", f"""
    WITH names AS (SELECT DISTINCT winery AS value FROM bench_cards), words AS (SELECT DISTINCT value, unnest(string_split({_phrase('value')}, ' ')) AS phrase FROM names),
      lone AS (SELECT phrase, min(value) AS value FROM words WHERE length(phrase) >= 5 AND phrase NOT IN (
        SELECT unnest(string_split(grapes, ' ')) FROM bench_cards WHERE item_id % 5 = 0) GROUP BY phrase HAVING count(*) = 1),
      every AS (SELECT value, {_phrase('value')} AS phrase FROM names UNION SELECT value, phrase FROM lone UNION
        SELECT value, 'house ' || {_phrase('value')} FROM names WHERE value IN (SELECT min(value) FROM names))
    SELECT min(value) AS value, phrase FROM every WHERE phrase <> '' GROUP BY phrase HAVING count(*) = 1""")
def producer_aliases(v):
    """Names, one with a listed alias, and the words of names that only one producer has."""
    words = v.bench_cards.filter("item_id % 5 = 0").select(F.explode(F.split("grapes", " ")).alias("word"))
    first = v.bench_cards.agg(F.min("winery")).first()[0]
    return tg.single_owner_aliases(v.bench_cards, "winery", words, {first: ["House " + first]})


JOINED = {
    "duos": f"""SELECT DISTINCT parts, array_to_string(parts, '') AS joined FROM (
      SELECT unnest(list_transform(range(1, len(t) - n + 2), lambda i: t[i:i + n - 1])) AS parts FROM (
        SELECT unnest([{tokens('title')}, {tokens('winery')}, {tokens('grapes')}]) AS t FROM bench_cards), (VALUES (2), (3)) k(n))
      WHERE len(list_filter(parts, lambda w: length(w) < 3)) = 0 AND length(array_to_string(parts, '')) >= 7""",
    "joined": """SELECT joined, min(parts) AS parts FROM duos WHERE joined NOT IN (SELECT term FROM vocab) GROUP BY joined HAVING count(*) = 1""",
}


@query("ngram_joins", "T11", "SELECT joined, array_to_string(parts, ' ') AS parts FROM joined", {**INDEX_VIEWS, **JOINED})
def ngram_joins(v):
    index = v.bench_index
    return index.joined.select("joined", F.array_join("parts", " ").alias("parts"))


# ----------------------------------------------------------- fuzzy retrieval
# Every string left after up to b deletions: words within distance b share one.
ONE_DELETION = "list_transform(range(1, length({w}) + 1), lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1))"
DELETIONS = ("list_distinct(CASE WHEN {b} = 0 THEN [{w}] WHEN {b} = 1 THEN list_concat([{w}], " + ONE_DELETION
             + ") ELSE list_concat([{w}], " + ONE_DELETION + ", flatten(list_transform(" + ONE_DELETION
             + ", lambda d: list_transform(range(1, length(d) + 1), lambda j: substr(d, 1, j - 1) || substr(d, j + 1))))) END)")

MATCH_VIEWS = {
    **INDEX_VIEWS, **JOINED, **word_views("query_words"),
    "words": f"""SELECT query_id, raw, max(confidence) AS confidence FROM (SELECT query_id, confidence,
      unnest({words_sql(folded('text'))}) AS raw FROM obs WHERE on_target AND confidence >= 0.2) GROUP BY query_id, raw""",
    "query_words": "SELECT DISTINCT raw AS w FROM words",
    "asked": """SELECT term AS word, CASE WHEN length(term) <= 3 OR regexp_full_match(term, '[0-9]+') THEN 0
      WHEN length(term) <= 5 THEN 1 ELSE 2 END AS budget, length(term) AS size FROM variants GROUP BY term""",
    "near": """SELECT word, term, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, term) AS n FROM (
      SELECT word, term, damerau_levenshtein(word, term) AS distance FROM (
        SELECT DISTINCT word, budget, term FROM word_keys JOIN term_keys USING (key)) WHERE damerau_levenshtein(word, term) <= budget)) WHERE n <= 4""",
    "word_keys": f"SELECT word, budget, unnest({DELETIONS.format(w='word', b='budget')}) AS key FROM asked",
    "term_keys": f"SELECT term, unnest({DELETIONS.format(w='term', b='2')}) AS key FROM vocab",
    "hits": """SELECT raw, near.term, distance, 1 - distance / greatest(length(word), length(near.term))::DOUBLE AS similarity, prior
        FROM variants JOIN near ON variants.term = near.word
      UNION ALL SELECT raw, unnest(parts), 0, 1.0::DOUBLE, 0.96 * prior FROM variants JOIN joined ON variants.term = joined.joined""",
    "matches": """SELECT raw, term, distance, ms FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY ms DESC, term) AS n,
        max(ms) OVER (PARTITION BY raw) AS best FROM (SELECT raw, term, max(similarity * prior) AS ms,
          arg_max(distance, (similarity * prior, -distance)) AS distance FROM hits WHERE similarity >= 0.73 GROUP BY raw, term))
      WHERE n <= 5 AND ms >= best - 0.08""",
    "ev": """SELECT query_id, term, m.s AS s, m.c AS confidence, -m.d AS distance, m.ms AS ms FROM (
      SELECT query_id, term, max({'s': ms * (0.6 + 0.4 * confidence), 'c': confidence, 'd': -distance, 'ms': ms}) AS m
      FROM words JOIN matches USING (raw) GROUP BY query_id, term)""",
}


def bench_matches(v):
    index = v.bench_index
    words = v.documents.select(F.explode(tx.raw_words(F.col("text"))).alias("word")).distinct()
    return fz.term_matches(words, index.vocabulary.select("term"), index.joined, keys=index.keys)


@query("fuzzy_term_join", "J5 W6", """
    SELECT raw, term, distance, round(ms, 6) AS match_strength FROM matches""", {**MATCH_VIEWS, "query_words": WORD_VIEWS["doc_words"]})
def fuzzy_term_join(v):
    return bench_matches(v).select("raw", "term", "distance", F.round("match_strength", 6).alias("match_strength"))


@query("best_evidence", "A5", """
    SELECT query_id, term, round(s, 6) AS strength, confidence, distance FROM ev""", MATCH_VIEWS)
def best_evidence(v):
    evidence = ts.query_evidence(v.obs, v.bench_index, once=True)
    return evidence.select("query_id", "term", F.round("strength", 6).alias("strength"), "confidence", "distance")


@query("term_postings", "J6", """
    SELECT query_id, slug, count(*) AS shared FROM ev JOIN doc_terms USING (term) GROUP BY query_id, slug""", MATCH_VIEWS)
def term_postings(v):
    index = v.bench_index
    # The terms of a query come in one task: where the postings are sent, its pairs are counted there, nothing is written or shuffled.
    asked = ts.query_evidence(v.obs, index, once=True).select("query_id", "term")
    shared = asked.join(lookup(index.weights.select("term", "profile")), "term").groupBy(
        "query_id", "profile").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(lookup(index.members.select("profile", "slug")), "profile").select("query_id", "slug", "shared")


SCORE_VIEWS = {
    **MATCH_VIEWS,
    "facts": f"""SELECT slug, list_distinct({tokens('title')}) AS tt, list_distinct({tokens('winery')}) AS wt,
      list_distinct({tokens('grapes')}) AS gt, list_distinct({tokens('category')}) AS ct FROM bench_cards""",
    "card_facts": f"""SELECT *, list_filter(tt, lambda t: NOT list_contains(wt, t) AND length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+')
        AND t NOT IN {sql_in(fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS)}) AS identity,
      list_filter(tt, lambda t: t IN {sql_in(fv.SWEETNESS_TERMS)}) AS sugars,
      greatest(1, len(tt)) / (SELECT avg(greatest(1, len(tt))) FROM facts) AS damp FROM facts""",
    "marked": f"""SELECT e.*, idf, idf * s AS mass, coalesce(owners, 0) BETWEEN 1 AND 2 AND s >= 0.83 AND (length(e.term) >= 4 OR e.term IN {sql_in(fv.SHORT_IDENTIFIERS)}) AS is_producer,
      e.term IN {sql_in(fv.COLOR_TERMS)} AND distance = 0 AND confidence >= 0.65 AS is_color,
      e.term IN {sql_in(fv.SWEETNESS_TERMS)} AND distance = 0 AND confidence >= 0.65 AS is_sugar,
      e.term IN (SELECT term FROM grape_term) AND distance = 0 AND confidence >= 0.9 AND ms >= 0.96 AS is_grape
      FROM ev e JOIN vocab USING (term) LEFT JOIN winery_owner USING (term)""",
    "per_query": """SELECT query_id, sum(mass) AS total, max(CASE WHEN is_producer THEN mass * 1.4 END) AS penalty,
      list(term) FILTER (is_producer) AS producers, list(term) FILTER (is_color) AS colors, list(term) FILTER (is_sugar) AS sugars_read,
      list(term) FILTER (is_grape) AS grapes_read FROM marked GROUP BY query_id""",
    "per_pair": f"""SELECT query_id, slug, sum(mass) AS matched, sum(idf * w * s * s
        / CASE WHEN field = 'title' THEN 0.7 + 0.3 * damp ELSE 1 END * CASE WHEN m.term IN {sql_in(fv.TECHNICAL_TERMS)} THEN 0.35 ELSE 1 END
        * CASE WHEN regexp_full_match(m.term, '[0-9]+') OR (length(m.term) = 2 AND m.term NOT IN {sql_in(fv.SHORT_IDENTIFIERS)}) THEN 0.2 ELSE 1 END) AS base,
      sum(CASE WHEN list_contains(identity, m.term) THEN s ELSE 0 END) AS seen,
      count(*) FILTER (field IN ('title', 'winery', 'grapes') AND m.term NOT IN {sql_in(fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS)}
        AND (length(m.term) >= 3 OR (length(m.term) = 2 AND NOT regexp_full_match(m.term, '[0-9]+') AND df <= 5))) AS identity_terms
      FROM marked m JOIN doc_terms USING (term) JOIN card_facts USING (slug) JOIN (SELECT term, df FROM vocab) USING (term) GROUP BY query_id, slug""",
    "scored": """SELECT *, round(base - CASE WHEN off_winery THEN penalty ELSE 0 END - 3 * (off_color::INT + off_sugar::INT + off_grape::INT)
        + 2 * seen / greatest(1, len(identity)), 5) AS score FROM (SELECT p.*, q.total, q.penalty, f.identity,
        producers IS NOT NULL AND len(list_intersect(producers, wt)) = 0 AS off_winery,
        coalesce(len(colors) = 1 AND len(ct) > 0 AND NOT list_contains(ct, colors[1]), false) AS off_color,
        coalesce(len(sugars_read) = 1 AND len(sugars) > 0 AND NOT list_contains(sugars, sugars_read[1]), false) AS off_sugar,
        coalesce(len(grapes_read) = 1 AND len(gt) > 0 AND NOT list_contains(gt, grapes_read[1]), false) AS off_grape
      FROM per_pair p JOIN per_query q USING (query_id) JOIN card_facts f USING (slug))""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS rank,
      first_value(score) OVER w AS first, nth_value(score, 2) OVER w AS second FROM scored
      WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, slug ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
}
CONFLICTS = """array_to_string(list_filter([CASE WHEN off_winery THEN 'winery' END, CASE WHEN off_color THEN 'category' END,
      CASE WHEN off_sugar THEN 'sweetness' END, CASE WHEN off_grape THEN 'grapes' END], lambda x: x IS NOT NULL), ',')"""


@query("text_search", "Q2 A6 A7 W3", f"""
    SELECT query_id, rank, slug, score, round(matched / greatest(total, 1e-9), 9) AS query_term_coverage,
      round(seen / greatest(1, len(identity)), 9) AS title_identity_coverage, {CONFLICTS} AS conflicts,
      round(CASE WHEN second IS NULL THEN 1.0 ELSE (first - second) / greatest(abs(first), 1) END, 9) AS relative_top_margin,
      CASE WHEN first > 0 AND CASE WHEN second IS NULL THEN 1.0 ELSE (first - second) / greatest(abs(first), 1) END >= 0.15
        AND max(CASE WHEN rank = 1 THEN matched / total >= 0.55 AND identity_terms >= 2 AND {CONFLICTS} = '' END) OVER (PARTITION BY query_id)
        THEN 'tentative_match' ELSE 'needs_review' END AS status FROM ranked QUALIFY rank <= 10""", SCORE_VIEWS)
def text_search(v):
    found = ts.text_search(v.obs, v.bench_cards, 10, v.bench_index)
    return found.select(
        "query_id", "rank", "slug", "score", F.array_join("conflicts", ",").alias("conflicts"), "status",
        *[F.round(c, 9).alias(c) for c in ("query_term_coverage", "title_identity_coverage", "relative_top_margin")])


@query("text_report", "Q2", f"""
    WITH told AS (SELECT query_id, status FROM (SELECT query_id, rank, CASE WHEN first > 0
          AND CASE WHEN second IS NULL THEN 1.0 ELSE (first - second) / greatest(abs(first), 1) END >= 0.15
          AND matched / total >= 0.55 AND identity_terms >= 2 AND {CONFLICTS} = '' THEN 'tentative_match' ELSE 'needs_review' END AS status FROM ranked) WHERE rank = 1),
      said AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT term)), ' ') AS said FROM ev GROUP BY query_id),
      strange AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT raw)), ' ') AS unmatched FROM words
        WHERE raw IN (SELECT raw FROM variants) AND raw NOT IN (SELECT raw FROM matches) GROUP BY query_id)
    SELECT query_id, count(*) AS observations, coalesce(any_value(status), 'no_text_candidates') AS status,
      coalesce(any_value(said), '') AS known_terms, coalesce(any_value(unmatched), '') AS unmatched_words
    FROM obs LEFT JOIN told USING (query_id) LEFT JOIN said USING (query_id) LEFT JOIN strange USING (query_id) GROUP BY query_id""", SCORE_VIEWS)
def text_report(v):
    index = v.bench_index
    reading = ts.read_lines(v.obs, index)
    found = ts.text_search(v.obs, v.bench_cards, 10, index, reading.evidence)
    report = ts.text_report(v.obs, reading, found)
    return report.select("query_id", "observations", "status", *[F.array_join(c, " ").alias(c) for c in ("known_terms", "unmatched_words")])


@query("text_evidence", "Q2 A5", f"""
    WITH best AS (SELECT query_id, slug FROM ranked WHERE rank <= 10),
      sources AS (SELECT query_id, term, array_to_string(list_sort(list(DISTINCT line_no)), ',') AS sources FROM (SELECT query_id, line_no,
        unnest({words_sql(folded('text'))}) AS raw FROM obs WHERE on_target AND confidence >= 0.2) JOIN matches USING (raw) GROUP BY query_id, term)
    SELECT query_id, slug, m.term, field, distance, round(s, 6) AS strength, sources, round(idf * w * s * s
        / CASE WHEN field = 'title' THEN 0.7 + 0.3 * damp ELSE 1 END * CASE WHEN m.term IN {sql_in(fv.TECHNICAL_TERMS)} THEN 0.35 ELSE 1 END
        * CASE WHEN regexp_full_match(m.term, '[0-9]+') OR (length(m.term) = 2 AND m.term NOT IN {sql_in(fv.SHORT_IDENTIFIERS)}) THEN 0.2 ELSE 1 END, 6) AS contribution
    FROM best JOIN marked m USING (query_id) JOIN doc_terms d USING (slug, term) JOIN card_facts USING (slug) JOIN sources USING (query_id, term)""", SCORE_VIEWS)
def text_evidence(v):
    index = v.bench_index
    evidence = ts.read_lines(v.obs, index, sources=True).evidence
    found = ts.text_search(v.obs, v.bench_cards, 10, index, evidence)
    rows = ts.attach_evidence(found, evidence, index)
    return rows.select("query_id", "slug", "term", "field", "distance", F.array_join("sources", ",").alias("sources"),
                       *[F.round(c, 6).alias(c) for c in ("strength", "contribution")])


@query("missing_terms", "O7", """
    SELECT query_id, slug, term FROM (SELECT r.query_id, r.slug, e.term, row_number() OVER (PARTITION BY r.query_id, r.slug
      ORDER BY idf * s DESC, e.term) AS n FROM (SELECT query_id, slug FROM ranked WHERE rank <= 10) r JOIN ev e USING (query_id) JOIN vocab USING (term)
      WHERE NOT EXISTS (SELECT 1 FROM doc_terms d WHERE d.slug = r.slug AND d.term = e.term)) WHERE n <= 12""", SCORE_VIEWS)
def missing_terms(v):
    index = v.bench_index
    evidence = ts.query_evidence(v.obs, index)
    found = ts.text_search(v.obs, v.bench_cards, 10, index, evidence)
    return ts.missing_terms(found, evidence, index).select("query_id", "slug", "term")


PRODUCER_VIEWS = {
    **word_views("query_words"),
    "excluded": f"SELECT DISTINCT term FROM (SELECT unnest({tokens('grapes')}) AS term FROM bench_cards UNION ALL SELECT unnest({tokens('region')}) FROM bench_cards)",
    "names": f"SELECT winery, {tokens('winery')} AS w FROM (SELECT DISTINCT winery FROM bench_cards)",
    "owner": f"""SELECT term, min(winery) AS winery FROM (SELECT winery, unnest(w) AS term FROM names UNION SELECT winery, w[1] || w[2] FROM names
        WHERE len(w) = 2 AND length(w[1]) >= 3 AND length(w[2]) >= 3 AND w[1] NOT IN (SELECT term FROM excluded) AND w[2] NOT IN (SELECT term FROM excluded)
          AND w[1] NOT IN {sql_in(fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS + fv.GENERIC_PRODUCER_TERMS)}
          AND w[2] NOT IN {sql_in(fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS + fv.GENERIC_PRODUCER_TERMS)})
      WHERE length(term) >= 4 AND term NOT IN (SELECT term FROM excluded)
        AND term NOT IN {sql_in(fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS + fv.GENERIC_PRODUCER_TERMS)}
      GROUP BY term HAVING count(DISTINCT winery) = 1""",
    "words": f"""SELECT query_id, raw, max(confidence) AS confidence FROM (SELECT query_id, confidence,
      unnest({words_sql(folded('text'))}) AS raw FROM obs WHERE on_target AND confidence BETWEEN 0.85 AND 1) GROUP BY query_id, raw""",
    "query_words": "SELECT DISTINCT raw AS w FROM words",
    "near": """SELECT word, term, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, term) AS n FROM (
      SELECT v.term AS word, o.term, damerau_levenshtein(v.term, o.term) AS distance FROM (SELECT DISTINCT term FROM variants) v JOIN owner o
        ON abs(length(v.term) - length(o.term)) <= CASE WHEN length(v.term) >= 8 THEN 2 ELSE 0 END
      WHERE damerau_levenshtein(v.term, o.term) <= CASE WHEN length(v.term) >= 8 THEN 2 ELSE 0 END)) WHERE n <= 4""",
    "owned": """SELECT raw, winery, max((1 - distance / greatest(length(word), length(near.term))::DOUBLE) * prior) AS sim FROM variants
      JOIN near ON variants.term = near.word JOIN owner ON owner.term = near.term GROUP BY raw, winery HAVING sim >= 0.8""",
    "named": """SELECT raw, winery, sim FROM (SELECT *, row_number() OVER w AS n, lead(sim) OVER w AS second FROM owned
      WINDOW w AS (PARTITION BY raw ORDER BY sim DESC, winery)) WHERE n = 1 AND (second IS NULL OR sim - second >= 0.08)""",
    "votes": """SELECT query_id, winery, max(sim * confidence) AS strength FROM words JOIN named USING (raw) GROUP BY query_id, winery""",
}


@query("producer_search", "Q3 A11", """
    SELECT query_id, CASE WHEN strength IS NULL THEN 'unreadable' WHEN second IS NULL OR strength - second >= 0.08 THEN 'recognized' ELSE 'ambiguous' END AS status,
      CASE WHEN second IS NULL OR strength - second >= 0.08 THEN winery END AS winery, round(strength, 6) AS strength
    FROM (SELECT DISTINCT query_id FROM obs) LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER w AS n, lead(strength) OVER w AS second FROM votes
      WINDOW w AS (PARTITION BY query_id ORDER BY strength DESC, winery)) WHERE n = 1) USING (query_id)""", PRODUCER_VIEWS)
def producer_search(v):
    found = ts.producer_search(v.obs, v.bench_cards)
    return found.select("query_id", "status", "winery", F.round("strength", 6).alias("strength"))


@query("text_reliability", "A14", f"""
    SELECT query_id, slug, round(coalesce(max(CASE WHEN field IN ('title', 'grapes') AND term <> lower(winery)
        AND term NOT IN {sql_in(fv.COLOR_TERMS + fv.SWEETNESS_TERMS + fv.TECHNICAL_TERMS)} AND length(term) >= 4 THEN match_strength END)
      * CASE WHEN bool_or(field = 'winery' AND match_strength >= 0.7) THEN 1 ELSE 0.35 END, 0), 6) AS reliability
    FROM evidence JOIN cards USING (slug) GROUP BY query_id, slug""")
def text_reliability(v):
    evidence = v.evidence_of(v.candidates).withColumnRenamed("match_strength", "strength")
    wineries = v.cards.select("slug", tx.tokens("winery").alias("winery_terms"))
    found = ts.text_reliability(evidence, wineries)
    return found.select("query_id", "slug", F.round("reliability", 6).alias("reliability"))


@query("shortlist_consensus", "A12", """
    SELECT query_id, CASE WHEN count(*) = 3 AND count(DISTINCT slug) = 3 AND count(DISTINCT winery) = 1 AND count(winery) = 3 THEN min(winery) END AS producer
    FROM (SELECT query_id, slug, CASE WHEN size % 9 <> 0 THEN 'Brand#' || (size % 2) END AS winery FROM candidates JOIN cards USING (slug) WHERE rank <= 3)
    GROUP BY query_id""")
def shortlist_consensus(v):
    from catmatch.operators.recommend import shortlist_consensus as op
    cards = v.cards.select("slug", F.when(F.col("size") % 9 != 0, F.concat(F.lit("Brand#"), F.col("size") % 2)).alias("producer"))
    return op(v.candidates, cards)


@query("line_terms", "A13", """
    SELECT query_id, array_to_string(list_sort(list(DISTINCT word)), ',') AS terms FROM (
      SELECT query_id, unnest(string_split(lower(text), ' ')) AS word, 'Brand#' || (query_id % 25 + 1) AS producer FROM part_lines WHERE on_target AND confidence >= 0.8)
    JOIN (SELECT winery AS producer, word FROM (SELECT winery, slug, unnest(list_distinct(string_split(title, ' '))) AS word FROM cards)
      GROUP BY winery, word HAVING count(*) >= 2) USING (producer, word)
    WHERE length(word) >= 4 AND word NOT IN ('blue', 'gear') GROUP BY query_id""")
def line_terms(v):
    from catmatch.operators.recommend import line_terms as op
    queries = v.part_lines.select("query_id", F.concat(F.lit("Brand#"), F.col("query_id") % 25 + 1).alias("producer")).distinct()
    titles = v.cards.select("slug", "title", F.col("winery").alias("producer"))
    found = op(queries, v.part_lines, titles, ["blue", "gear"])
    return found.select("query_id", F.array_join("line_terms", ",").alias("terms"))
