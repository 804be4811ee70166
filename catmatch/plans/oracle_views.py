"""The domain views once more as DuckDB SQL, for the correctness check."""
from __future__ import annotations

import re

from catmatch import fixed_values as fv


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def sql_map(mapping) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in mapping.items()) + "}"


ALIASES = sql_map(fv.WORD_ALIASES)
_CONF = "(60 + (({k}) * 31 + ({p}) * 17) % 41) / 100.0::DOUBLE"


def confidence(key: str, position: str) -> str:
    return _CONF.format(k=key, p=position)


def folded(text: str) -> str:
    return f"replace(lower({text}), 'ß', 'ss')"


def canonical(word: str) -> str:
    plain = f"strip_accents({folded(word)})"
    return f"coalesce({ALIASES}[{plain}], {plain})"


def usable(word: str) -> str:
    return (f"(length({word}) >= 2 AND {word} NOT IN {sql_in(fv.STOP_WORDS)} "
            f"AND NOT regexp_full_match({word}, '[0-9]{{4,}}'))")


def tokens(text: str) -> str:
    """Canonical usable words of a text expression, as a DuckDB list."""
    words = f"regexp_extract_all(strip_accents({folded(text)}), '[\\p{{L}}\\p{{N}}]+')"
    alias = f"list_transform({words}, lambda w: coalesce({ALIASES}[w], w))"
    return f"list_filter({alias}, lambda t: {usable('t')})"


VIEWS = {
    "cards": """SELECT 'p' || p_partkey AS slug, p_name AS title, p_brand AS winery, p_type AS category,
        split_part(p_name, ' ', 2) AS grapes, n_name AS region, p_size AS size,
        p_retailprice AS price, p_partkey,
        (['confirmed', 'applied', 'pending'])[p_partkey % 3 + 1] AS review_status,
        CASE p_size % 3 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'LARGE' END AS review_sweetness,
        CASE WHEN p_size % 5 = 0 THEN 'PROMO' END AS sweetness
        FROM part JOIN nation ON n_nationkey = p_partkey % 25""",
    "feed_list": """SELECT 'p' || p_partkey AS slug, p_partkey,
        CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS title, p_type AS category,
        p_brand AS manufacturer, NULL::VARCHAR AS region,
        CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS rating,
        CASE WHEN p_partkey % 5 <> 0 THEN 'img/' || p_partkey || '.PNG?v=1' END AS image FROM part""",
    "feed_detail": """SELECT 'p' || p_partkey AS slug, upper(p_name) AS title,
        CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS category,
        CASE WHEN p_partkey % 3 <> 0 THEN 'NATION_' || (p_partkey % 25) END AS region,
        (p_size * 3)::DOUBLE AS alcohol, string_split(p_name, ' ') AS grapes,
        (1880 + p_size * 5)::VARCHAR AS vintage FROM part WHERE p_partkey % 4 <> 0""",
    "known": """SELECT 'p' || p_partkey AS slug, p_name AS name,
        CASE WHEN p_partkey % 2 = 0 THEN 'key/' || p_partkey END AS image_key
        FROM part WHERE p_partkey % 3 = 0""",
    "parts_dup": "SELECT p_partkey // 2 AS slug, p_name FROM part",
    "obs": f"""SELECT query_id, line_no, text, {confidence('query_id', 'line_no')} AS confidence,
        (query_id + line_no) % 7 <> 0 AS on_target FROM (
        SELECT doc_id AS query_id, unnest(string_split(text, chr(10))) AS text,
        unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)""",
    "part_lines": f"""SELECT p_partkey // 2 AS query_id, p_partkey % 2 AS line_no,
        p_name || ' ' || p_type AS text, {confidence('p_partkey', '0')} AS confidence,
        p_partkey % 7 <> 0 AS on_target FROM part""",
    "bench_cards": """SELECT 'b' || item_id AS slug, item_id,
        array_to_string(string_split(text, ' ')[1:12], ' ') AS title,
        array_to_string(string_split(text, ' ')[13:14], ' ') AS winery,
        array_to_string(string_split(text, ' ')[15:], ' ') AS grapes,
        CASE WHEN item_id % 2 = 0 THEN 'white' ELSE 'red' END AS category,
        'NATION_' || (item_id % 25) AS region FROM benchmark""",
    "bench_terms": f"SELECT DISTINCT item_id, unnest({tokens('text')}) AS term FROM benchmark",
    "query_views": """SELECT vec_id // 30 AS query_id, vec_id AS view_id,
        CASE WHEN (vec_id // 30) % 4 = 3 AND (vec_id // 10) % 3 = 0 THEN 'reference'
        ELSE (['body', 'label', 'flat'])[(vec_id // 10) % 3 + 1] END AS family,
        embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 10 = 0""",
    "gallery_views": """SELECT vec_id AS view_id, vec_id // 5 AS record_id,
        (['body', 'label', 'flat', 'reference', 'augmented'])[vec_id % 5 + 1] AS family,
        CASE WHEN vec_id % 7 = 0 THEN ['b' || label, 'b' || (label + 10)] ELSE ['b' || label] END AS slugs,
        embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 10 <> 0""",
    "document_views": """SELECT doc_id AS query_id, doc_id * 2 + k AS view_id, CASE WHEN k = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'label' ELSE 'flat' END
        WHEN doc_id % 4 = 3 THEN 'reference' ELSE 'body' END AS family, embedding::DOUBLE[] AS vector
        FROM documents CROSS JOIN (VALUES (0), (1)) x(k) JOIN embeddings ON vec_id = (doc_id * 2 + k) % (SELECT count(*) FROM embeddings)""",
    "card_views": """SELECT p_partkey AS record_id, p_partkey * 2 + k AS view_id, CASE WHEN k = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'flat' ELSE 'label' END
        WHEN p_partkey % 5 = 0 THEN 'reference' ELSE 'body' END AS family, 'p' || p_partkey AS slug, embedding::DOUBLE[] AS vector
        FROM part CROSS JOIN (VALUES (0), (1)) x(k) JOIN embeddings ON vec_id = (p_partkey * 3 + k * 7) % (SELECT count(*) FROM embeddings)""",
    "scored_pairs": """SELECT o_custkey AS query_id, 'p' || l_partkey AS slug, l_partkey AS p_partkey,
        max(l_extendedprice) / 100000 AS score, 1 - max(l_discount) * 5 AS visual_similarity,
        max(l_quantity) / 5 - 2 AS text_score, max(l_tax) * 12.5 AS match_score,
        (o_custkey + l_partkey) % 5 = 0 AS producer_match,
        list_filter([CASE WHEN (o_custkey + l_partkey) % 6 = 0 THEN 'winery' END,
          CASE WHEN (o_custkey + l_partkey) % 7 = 0 THEN 'grapes' END,
          CASE WHEN (o_custkey + l_partkey) % 8 = 0 THEN 'category' END,
          CASE WHEN (o_custkey + l_partkey) % 9 = 0 THEN 'sweetness' END],
          lambda c: c IS NOT NULL) AS conflicts
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "candidates": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, slug) AS rank FROM scored_pairs) WHERE rank <= 5""",
    "evidence": f"""SELECT query_id, slug, e.field AS field, e.term AS term, e.confidence AS confidence,
        e.match_strength AS match_strength FROM (
        SELECT query_id, slug, unnest(list_filter([
          CASE WHEN pair % 3 <> 0 THEN {{'field': 'title', 'term': w1,
            'confidence': (80 + pair % 21) / 100.0::DOUBLE, 'match_strength': (75 + pair % 26) / 100.0::DOUBLE}} END,
          CASE WHEN pair % 4 <> 0 THEN {{'field': 'title', 'term': w2,
            'confidence': (70 + pair % 31) / 100.0::DOUBLE, 'match_strength': 1.0::DOUBLE}} END,
          CASE WHEN pair % 4 = 1 THEN {{'field': 'title', 'term': w2,
            'confidence': 0.9::DOUBLE, 'match_strength': 0.8::DOUBLE}} END,
          CASE WHEN pair % 2 = 0 THEN {{'field': 'winery', 'term': lower(winery),
            'confidence': (85 + pair % 16) / 100.0::DOUBLE, 'match_strength': 0.95::DOUBLE}} END],
          lambda e: e IS NOT NULL)) AS e FROM (
        SELECT query_id, c.slug, query_id + c.p_partkey AS pair, winery,
          {canonical("split_part(title, ' ', 1)")} AS w1, {canonical("split_part(title, ' ', 2)")} AS w2
          FROM candidates c JOIN cards USING (slug)))""",
    "scan_log": """SELECT event_id AS scan_id, epoch_us(ts) AS ts, user_id,
        json_extract_string(props, '$.k') AS item_id,
        CASE event_type WHEN 'signup' THEN 'legacy' WHEN 'purchase' THEN 'user_confirmed'
          WHEN 'click' THEN 'score_confirmed' WHEN 'view' THEN 'candidates_unverified'
          ELSE 'not_in_catalog' END AS status,
        'Vale of NATION_' || (user_id % 25) AS region, value FROM events""",
    "territories": """SELECT 't' || n_nationkey AS territory_id, n_name AS name,
        [lower(n_name)] AS aliases,
        CASE WHEN n_nationkey % 6 = 5 THEN 0 ELSE n_nationkey * 4 + 3 END::BIGINT AS total_items,
        n_nationkey % 6 = 5 AS locked FROM nation""",
    "region_territory": """SELECT region, arg_max(territory_id, length(alias) * 1000 - n) AS territory_id FROM (
        SELECT DISTINCT region FROM scan_log) JOIN (
        SELECT territory_id, unnest(aliases) AS alias, substr(territory_id, 2)::INT AS n FROM territories)
        ON contains(lower(region), alias) GROUP BY region""",
    "ledger": """SELECT user_id, ts, scan_id, 1 + item_id::BIGINT % 30 AS delta FROM scan_log""",
    "purchases": """SELECT o_custkey AS user_id, 'p' || l_partkey AS slug, epoch_us(o_orderdate) AS ts,
        l_orderkey AS order_id, l_linenumber AS line, l_quantity::BIGINT AS quantity, l_returnflag,
        o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "cellar": """SELECT *, CASE WHEN quantity > 0 THEN 'IN_STOCK' ELSE 'CONSUMED' END AS status FROM (
        SELECT user_id, slug, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE quantity END)::BIGINT AS quantity,
        max(ts) AS updated_at FROM purchases GROUP BY user_id, slug)""",
    "favorites": """SELECT user_id, slug, arg_max(CASE WHEN substr(o_orderpriority, 1, 1) < '3' THEN 'LIKED'
        ELSE 'WISH' END, (ts, order_id, line)) AS kind, max(ts) AS added_at
        FROM purchases WHERE l_returnflag <> 'R' GROUP BY user_id, slug""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the views it uses, dependencies first."""
    views = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in views:
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                visit(views[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    prefix = "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in ordered)
    own = body.strip()
    return prefix + (",\n" + own[5:] if own.upper().startswith("WITH ") else "\n" + body)
