"""Domain views over the shared tables: the catalogue, evidence and activity the operators read.

Each view is a lazy DataFrame; the twin SQL text in ``plans/oracle_views.py``
states the same view independently for the correctness check.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catmatch.functions import text as tx
from catmatch.sources.tables import Tables, spread


def confidence_of(key: Column, position: Column) -> Column:
    return (60 + (key * 31 + position * 17) % 41) / 100


_INDEXES: dict = {}


class Views(Tables):
    # ---------------------------------------------------------------- catalogue
    @property
    def cards(self) -> DataFrame:
        nation = self.nation.select("n_nationkey", F.col("n_name").alias("region"))
        part = self.part.withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int"))
        size = F.col("p_size")
        return part.join(nation, "n_nationkey").select(
            F.concat(F.lit("p"), "p_partkey").alias("slug"),
            F.col("p_name").alias("title"), F.col("p_brand").alias("winery"),
            F.col("p_type").alias("category"),
            F.split("p_name", " ")[1].alias("grapes"), "region",
            size.alias("size"), F.col("p_retailprice").alias("price"), "p_partkey",
            F.element_at(F.array(F.lit("confirmed"), F.lit("applied"), F.lit("pending")),
                         (F.col("p_partkey") % 3 + 1).cast("int")).alias("review_status"),
            F.when(size % 3 == 0, "SMALL").when(size % 3 == 1, "LARGE").alias("review_sweetness"),
            F.when(size % 5 == 0, "PROMO").alias("sweetness"))

    @property
    def feed_list(self) -> DataFrame:
        return self.part.select(
            F.concat(F.lit("p"), "p_partkey").alias("slug"), "p_partkey",
            F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).alias("title"),
            F.col("p_type").alias("category"), F.col("p_brand").alias("manufacturer"),
            F.lit(None).cast("string").alias("region"),
            F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("rating"),
            F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("img/"), "p_partkey", F.lit(".PNG?v=1")))
            .alias("image"))

    @property
    def feed_detail(self) -> DataFrame:
        return self.part.filter(F.col("p_partkey") % 4 != 0).select(
            F.concat(F.lit("p"), "p_partkey").alias("slug"),
            F.upper("p_name").alias("title"),
            F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("category"),
            F.when(F.col("p_partkey") % 3 != 0,
                   F.concat(F.lit("NATION_"), F.col("p_partkey") % 25)).alias("region"),
            (F.col("p_size") * 3).cast("double").alias("alcohol"),
            F.split("p_name", " ").alias("grapes"),
            (1880 + F.col("p_size") * 5).cast("string").alias("vintage"))

    @property
    def known(self) -> DataFrame:
        return self.part.filter(F.col("p_partkey") % 3 == 0).select(
            F.concat(F.lit("p"), "p_partkey").alias("slug"), F.col("p_name").alias("name"),
            F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("key/"), "p_partkey"))
            .alias("image_key"))

    @property
    def parts_dup(self) -> DataFrame:
        return self.part.select(F.expr("p_partkey div 2").alias("slug"), "p_name")

    # ---------------------------------------------------------------- text evidence
    @property
    def obs(self) -> DataFrame:
        lines = spread(self.documents.select("doc_id", "text")).select(
            F.col("doc_id").alias("query_id"), F.posexplode(F.split("text", "\n"))
            .alias("line_no", "text"))
        return lines.select(
            "query_id", F.col("line_no").cast("bigint").alias("line_no"), "text",
            confidence_of(F.col("query_id"), F.col("line_no")).alias("confidence"),
            ((F.col("query_id") + F.col("line_no")) % 7 != 0).alias("on_target"))

    @property
    def part_lines(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.part.select(
            F.expr("p_partkey div 2").alias("query_id"), (key % 2).alias("line_no"),
            F.concat_ws(" ", "p_name", "p_type").alias("text"),
            confidence_of(key, F.lit(0)).alias("confidence"), (key % 7 != 0).alias("on_target"))

    @property
    def bench_cards(self) -> DataFrame:
        """The benchmark passages as catalogue cards."""
        text, key = F.col("text"), F.col("item_id")
        return self.benchmark.select(
            F.concat(F.lit("b"), "item_id").alias("slug"), "item_id",
            F.array_join(F.slice(F.split(text, " "), 1, 12), " ").alias("title"),
            F.array_join(F.slice(F.split(text, " "), 13, 2), " ").alias("winery"),
            F.array_join(F.slice(F.split(text, " "), F.lit(15), F.size(F.split(text, " "))), " ").alias("grapes"),
            F.when(key % 2 == 0, "white").otherwise("red").alias("category"),
            F.concat(F.lit("NATION_"), key % 25).alias("region"))

    @property
    def bench_index(self):
        """The text index of the passages, built once per session and directory."""
        from catmatch.operators.text_search import build_index
        key = (self.spark.sparkContext.applicationId, self.directory)
        if key not in _INDEXES:
            _INDEXES[key] = build_index(self.bench_cards)
        return _INDEXES[key]

    @property
    def bench_terms(self) -> DataFrame:
        words = F.explode(F.array_distinct(tx.tokens("text")))
        return self.benchmark.select("item_id", words.alias("term"))

    # ---------------------------------------------------------------- vectors
    @property
    def query_views(self) -> DataFrame:
        query = F.expr("vec_id div 30")
        family = F.element_at(F.array(F.lit("body"), F.lit("label"), F.lit("flat")),
                              (F.expr("vec_id div 10") % 3 + 1).cast("int"))
        return self.embeddings.filter("vec_id % 10 = 0").select(
            query.alias("query_id"), F.col("vec_id").alias("view_id"),
            F.when((query % 4 == 3) & (family == "body"), "reference").otherwise(family)
            .alias("family"), F.col("embedding").alias("vector"))

    @property
    def gallery_views(self) -> DataFrame:
        families = F.array(*[F.lit(f) for f in ("body", "label", "flat", "reference", "augmented")])
        own = F.concat(F.lit("b"), "label")
        shared = F.array(own, F.concat(F.lit("b"), F.col("label") + 10))
        return self.embeddings.filter("vec_id % 10 <> 0").select(
            F.col("vec_id").alias("view_id"), F.expr("vec_id div 5").alias("record_id"),
            F.element_at(families, (F.col("vec_id") % 5 + 1).cast("int")).alias("family"),
            F.when(F.col("vec_id") % 7 == 0, shared).otherwise(F.array(own)).alias("slugs"),
            F.col("embedding").alias("vector"))

    def _vector_of(self, rows: DataFrame, number: Column) -> DataFrame:
        """Rows with the embedding of a number, modulo how many there are."""
        vectors = self.embeddings.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vector"))
        total = self.embeddings.agg(F.count(F.lit(1))).scalar()
        return rows.withColumn("_id", number % total).join(vectors, "_id").drop("_id")

    @property
    def document_views(self) -> DataFrame:
        """Two views of every document."""
        key, k = F.col("query_id"), F.col("k")
        rows = self.documents.select(F.col("doc_id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        family = F.when(k == 1, F.when(key % 2 == 0, "label").otherwise("flat")).when(key % 4 == 3, "reference").otherwise("body")
        return self._vector_of(rows.withColumn("view_id", key * 2 + k).withColumn("family", family), key * 2 + k).drop("k")

    @property
    def card_views(self) -> DataFrame:
        """Two views of every card."""
        key, k = F.col("p_partkey"), F.col("k")
        rows = self.part.select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        family = F.when(k == 1, F.when(key % 3 == 0, "flat").otherwise("label")).when(key % 5 == 0, "reference").otherwise("body")
        rows = rows.select(key.alias("record_id"), (key * 2 + k).alias("view_id"), family.alias("family"),
                           F.array(F.concat(F.lit("p"), key)).alias("slugs"), (key * 3 + k * 7).alias("_number"))
        return self._vector_of(rows, F.col("_number")).drop("_number")

    # ---------------------------------------------------------------- shortlists
    @property
    def scored_pairs(self) -> DataFrame:
        """(customer, part) scores from purchases: one scored candidate per pair."""
        line = self.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount",
                                    "l_tax", "l_quantity")
        orders = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        pair = F.col("o_custkey") + F.col("l_partkey")
        grouped = line.join(orders, "l_orderkey").groupBy("o_custkey", "l_partkey").agg(
            F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"),
            F.max("l_tax").alias("tax"), F.max("l_quantity").alias("quantity"))
        return grouped.select(
            F.col("o_custkey").alias("query_id"), F.concat(F.lit("p"), "l_partkey").alias("slug"),
            F.col("l_partkey").alias("p_partkey"),
            (F.col("price") / 100000).alias("score"),
            (1 - F.col("discount") * 5).alias("visual_similarity"),
            (F.col("quantity") / 5 - 2).alias("text_score"),
            (F.col("tax") * 12.5).alias("match_score"),
            (pair % 5 == 0).alias("producer_match"),
            F.filter(F.array(F.when(pair % 6 == 0, F.lit("winery")),
                             F.when(pair % 7 == 0, F.lit("grapes")),
                             F.when(pair % 8 == 0, F.lit("category")),
                             F.when(pair % 9 == 0, F.lit("sweetness"))),
                     lambda c: c.isNotNull()).alias("conflicts"))

    @property
    def candidates(self) -> DataFrame:
        from catmatch.operators.ranking import top_k
        return top_k(self.scored_pairs, ["query_id"], [F.col("score").desc(), F.col("slug")], 5)

    def evidence_of(self, candidates: DataFrame) -> DataFrame:
        """Evidence rows of a shortlist: title words and producer names it was found by."""
        words = F.split("title", " ")
        cards = self.cards.select("slug", "winery", tx.canonical(words[0]).alias("first"), tx.canonical(words[1]).alias("second"))
        joined = candidates.select("query_id", "slug", "p_partkey").join(cards, "slug")
        pair = F.col("query_id") + F.col("p_partkey")

        def row(keep, field, term, confidence, strength):
            return F.when(keep, F.struct(F.lit(field).alias("field"), term.alias("term"),
                                         confidence.alias("confidence"), strength.alias("match_strength")))

        first, second = F.col("first"), F.col("second")
        rows = F.filter(F.array(
            row(pair % 3 != 0, "title", first, (80 + pair % 21) / 100, (75 + pair % 26) / 100),
            row(pair % 4 != 0, "title", second, (70 + pair % 31) / 100, F.lit(1.0)),
            row(pair % 4 == 1, "title", second, F.lit(0.9), F.lit(0.8)),
            row(pair % 2 == 0, "winery", F.lower("winery"), (85 + pair % 16) / 100, F.lit(0.95)),
        ), lambda e: e.isNotNull())
        return joined.select("query_id", "slug", F.explode(rows).alias("e")).select(
            "query_id", "slug", "e.*")

    # ---------------------------------------------------------------- activity
    @property
    def scan_log(self) -> DataFrame:
        status = (F.when(F.col("event_type") == "signup", "legacy")
                  .when(F.col("event_type") == "purchase", "user_confirmed")
                  .when(F.col("event_type") == "click", "score_confirmed")
                  .when(F.col("event_type") == "view", "candidates_unverified")
                  .otherwise("not_in_catalog"))
        return self.events.select(
            F.col("event_id").alias("scan_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
            "user_id", F.get_json_object("props", "$.k").alias("item_id"), status.alias("status"),
            F.concat(F.lit("Vale of NATION_"), F.col("user_id") % 25).alias("region"), "value")

    @property
    def territories(self) -> DataFrame:
        """Territory dimension over the nations: every sixth one is locked."""
        key = F.col("n_nationkey")
        return self.nation.select(
            F.concat(F.lit("t"), key).alias("territory_id"), F.col("n_name").alias("name"),
            F.array(F.lower("n_name")).alias("aliases"),
            F.when(key % 6 == 5, 0).otherwise(key * 4 + 3).cast("bigint").alias("total_items"),
            (key % 6 == 5).alias("locked"))

    @property
    def ledger(self) -> DataFrame:
        return self.scan_log.select(
            "user_id", "ts", "scan_id", (1 + F.col("item_id").cast("bigint") % 30).alias("delta"))

    @property
    def purchases(self) -> DataFrame:
        line = self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                    "l_returnflag")
        orders = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
                                    "o_orderdate", "o_orderpriority")
        return line.join(orders, "l_orderkey").select(
            F.col("o_custkey").alias("user_id"), F.concat(F.lit("p"), "l_partkey").alias("slug"),
            F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"),
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
            F.col("l_quantity").cast("bigint").alias("quantity"), "l_returnflag",
            "o_orderpriority")

    @property
    def cellar(self) -> DataFrame:
        return self.purchases.groupBy("user_id", "slug").agg(
            F.sum(F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("quantity")))
            .alias("quantity"), F.max("ts").alias("updated_at")).withColumn(
            "status", F.when(F.col("quantity") > 0, "IN_STOCK").otherwise("CONSUMED"))

    @property
    def favorites(self) -> DataFrame:
        kind = F.when(F.substring("o_orderpriority", 1, 1) < "3", "LIKED").otherwise("WISH")
        latest = F.struct("ts", "order_id", "line")
        return self.purchases.filter("l_returnflag <> 'R'").groupBy("user_id", "slug").agg(
            F.max_by(kind, latest).alias("kind"), F.max("ts").alias("added_at"))
