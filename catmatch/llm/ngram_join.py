"""N-gram Jaccard join: documents whose sets of word shingles are nearly equal, and their components.

Multiple-global-order filtering. Two sets that are similar enough share a token of their
prefixes (the first few tokens) under every global order of tokens. The first order puts rare
tokens first, after a sketch of counts over all documents, and makes the groups; two sets go on
only if they share prefix tokens under a second and a third order too; then the whole sets are
compared. Equal sets are one node from the start, and sets already joined are not compared again:

1. Every group first compares its members with one leader, the one with the earliest token.
2. Groups that still hold several components compare all members, in blocks, inside tasks:
   length, places of the shared token and a histogram of the set rule out nearly all pairs
   exactly, and only what passes becomes a row.

Tokens and sets are named by 64-bit hashes of their words.

Defined cases: a text of fewer words than a shingle is one token, the whole sequence; a text
without words, or null, has an empty set and links with nothing; rows that repeat a doc_id are
documents of their own; the component of a document without an id is the smallest id it
reaches, or null; an empty table gives no rows; other columns are ignored, or kept by
`keep_one_of_each`.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catmatch.llm.common import materialize
from catmatch.llm.components import connected_components
from catmatch.llm.words import WordHashes, join_names, mix

SKETCH_BITS = 21  # of the count sketch: two million counters, whatever the corpus
_CHUNKS = 64
_BINS = 256
#: Members of a group that one task compares with each other; larger groups are cut into blocks.
BLOCK = 1024
#: Ids up to this number (8 MB) may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_META = ("doc_id long, node long, n long, first array<long>, second binary, third binary, histogram binary")


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct names of the runs of `size` words; of the whole, if it is shorter."""
    if not len(words):
        return words
    if len(words) < size:
        name = mix(words[:1], len(words))
        for word in words[1:]:
            name = join_names(name, np.array([word], np.uint64))
        return name
    names = words[:len(words) - size + 1]
    for k in range(1, size):
        names = join_names(names, words[k:len(words) - size + 1 + k])
    return np.unique(names)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(doc ids, sets) of batches of doc_id and text as bytes."""
    hashes = WordHashes()
    for batch in batches:
        yield batch.column(0).to_pylist(), [shingle_set(hashes.of(text, lower=True), size) for text in batch.column(1).to_pylist()]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))


def token_ranks(docs: DataFrame, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How common the tokens of each counter are, in half powers of two, over all documents."""
    width = (1 << bits) // _CHUNKS

    def count(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for _, sets in _sets(batches, size):
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64),
                                      minlength=1 << bits).astype(np.uint32)
        slot = TaskContext.get().partitionId()
        yield _rows([(slot, chunk, counts[chunk * width:(chunk + 1) * width].tobytes()) for chunk in range(_CHUNKS)])

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                                           pa.array([r[2] for r in rows], pa.binary())], names=["slot", "chunk", "counts"])

    def add(batches):  # rows sorted by slot and chunk
        key, total = None, None
        for batch in batches:
            for slot, chunk, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (slot, chunk) != key:
                    if key is not None:
                        yield _rows([(*key, np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes())])
                    key, total = (slot, chunk), np.zeros(width, np.uint64)
                total += np.frombuffer(counts, np.uint32)
        if key is not None:
            yield _rows([(*key, np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes())])

    texts = _texts(docs)
    schema = "slot long, chunk int, counts binary"
    rows, slots = texts.mapInArrow(count, schema), texts.rdd.getNumPartitions()
    while slots > 1:  # at most 64 sketches meet in a task
        slots = -(-slots // 64)
        rows = (rows.withColumn("slot", F.floor(F.col("slot") / 64)).repartition("slot", "chunk")
                .sortWithinPartitions("slot", "chunk").mapInArrow(add, schema))
    counts = np.zeros(1 << bits, np.uint32)
    for row in rows.select("chunk", "counts").collect():  # 64 rows of fixed size
        counts[row[0] * width:(row[0] + 1) * width] += np.frombuffer(row[1], np.uint32)
    return np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def describe(docs: DataFrame, size: int, percent: int, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, node, n, and for the filters the prefixes under three orders and a histogram of the set."""
    ranks = docs.sparkSession.sparkContext.broadcast(token_ranks(docs, size, bits))

    def row(doc_id, tokens: np.ndarray) -> tuple:
        n = len(tokens)
        if not n:
            return doc_id, None, 0, [], b"", b"", b""
        take = n + 1 - -(-percent * n // 100)
        rank = ranks.value[(tokens >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
        smallest = lambda keys: np.argpartition(keys, take - 1)[:take]
        keys = rank | (tokens >> np.uint64(8))
        at = smallest(keys)
        first = tokens[at[np.argsort(keys[at])]]
        second = tokens[smallest(rank | (mix(tokens, 3) >> np.uint64(8)))]
        third = tokens[smallest(mix(tokens, 4))]
        short = lambda found: np.sort(found.astype(np.uint32)).tobytes()
        histogram = np.minimum(np.bincount((tokens & np.uint64(_BINS - 1)).astype(np.int64), minlength=_BINS), 255)
        return doc_id, _node(tokens), n, _long(first), short(second), short(third), histogram.astype(np.uint8).tobytes()

    def rows(batches):
        for ids, sets in _sets(batches, size):
            made = list(zip(*(row(i, s) for i, s in zip(ids, sets))))
            if made:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)],
                                                 names=["doc_id", "node", "n", "first", "second", "third", "histogram"])

    return _texts(docs).mapInArrow(rows, _META)


def _long(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _node(tokens: np.ndarray) -> int:
    """The name of a set, as a signed long."""
    return int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "big", signed=True)


def _near(n_a, n_b, at_a, at_b, percent: int):
    """What a pair must meet where its first shared token stands `at` in either prefix; columns or arrays.

    All tokens before are in one set only: overlap / (overlap + at_a + at_b) bounds the similarity.
    """
    left, right = n_a - at_a, n_b - at_b
    rest = 100 - percent
    return ((percent * (at_a + at_b) <= rest * left) & (percent * (at_a + at_b) <= rest * right)
            & (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a))


def _compare_groups(rows: DataFrame, percent: int) -> DataFrame:
    """rows (token, cell, side, diagonal, place, n, node, root, histogram) sorted by token and cell → pairs (a, b) that may be similar."""
    schema = "a long, b long"

    def pairs_of(batch: dict[str, np.ndarray]) -> np.ndarray:
        starts = batch["starts"]
        groups = np.cumsum(starts)
        found = []
        step = 1
        while True:
            i = np.flatnonzero(groups[:-step] == groups[step:]) if step < len(groups) else np.empty(0, np.int64)
            if not len(i):
                break
            j = i + step
            ok = (batch["root"][i] != batch["root"][j]) & (batch["diagonal"][i] | (batch["side"][i] != batch["side"][j]))
            ok &= _near(batch["n"][i], batch["n"][j], batch["place"][i], batch["place"][j], percent)
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 4096):
                x, y = i[at:at + 4096], j[at:at + 4096]
                keep = _not_far(batch["histogram"][x], batch["histogram"][y], batch["n"][x] + batch["n"][y], percent)
                a, b = batch["node"][x[keep]], batch["node"][y[keep]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            step += 1
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def arrays(table: pa.Table) -> dict[str, np.ndarray]:
        out = {name: table.column(name).to_numpy() for name in ("token", "cell", "side", "diagonal", "place", "n", "node", "root")}
        out["histogram"] = np.frombuffer(b"".join(table.column("histogram").to_pylist()), np.uint8).reshape(-1, _BINS)
        new = np.ones(len(out["token"]), bool)
        new[1:] = (out["token"][1:] != out["token"][:-1]) | (out["cell"][1:] != out["cell"][:-1])
        return out | {"starts": new}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            token, cell = table.column("token").to_numpy(), table.column("cell").to_numpy()
            # the last group may go on in the next batch
            last = int(np.flatnonzero((token != token[-1]) | (cell != cell[-1])).max(initial=-1)) + 1
            kept = table.slice(last)
            if last:
                yield _pairs(pairs_of(arrays(table.slice(0, last))))
        if kept is not None and kept.num_rows:
            yield _pairs(pairs_of(arrays(kept)))

    return rows.mapInArrow(run, schema)


def _pairs(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])


def _not_far(x: np.ndarray, y: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Sets of `both` tokens together that differ in at most both (100 - p) / (100 + p); histograms differ in no more."""
    apart = np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64)
    return (100 + percent) * apart <= (100 - percent) * both


def _few(ids: DataFrame) -> DataFrame:
    """The ids, marked for broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _other_orders(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that share prefix tokens under the second and the third order too, and whose histograms are near."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = nodes.join(_few(asked), "node", "left_semi")
    side = lambda name: known.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "second", "third", "histogram")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(batches):
        for batch in batches:
            rows = batch.to_pylist()
            keep = [r for r in rows if _share(r["second_a"], r["second_b"]) and _share(r["third_a"], r["third_b"])]
            if keep:
                table = lambda name: np.frombuffer(b"".join(r[name] for r in keep), np.uint8).reshape(-1, _BINS)
                near = _not_far(table("histogram_a"), table("histogram_b"), np.array([r["n_a"] + r["n_b"] for r in keep]), percent)
                yield _pairs(np.array([(r["a"], r["b"]) for r in keep], np.int64)[near])

    return both.mapInArrow(check, "a long, b long")


def _share(x: bytes, y: bytes) -> bool:
    return len(np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))) > 0


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough; only the documents asked for are read again."""
    pairs = materialize(_other_orders(pairs, nodes, percent))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = materialize(nodes.select("doc_id", "node").join(_few(asked), "node", "left_semi").distinct())
    wanted = _few(ids.select(F.col("doc_id").alias("wanted")).distinct())
    texts = _texts(docs)
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi")

    def whole(batches):
        for _, sets in _sets(batches, size):
            sets = [s for s in sets if len(s)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    # A text of the same id that is not asked for has another node.
    sets = materialize(texts.mapInArrow(whole, "node long, tokens binary").join(ids.select("node"), "node", "left_semi")
                       .dropDuplicates(["node"]))
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b")), "b"))

    def compare(batches):
        for batch in batches:
            keep = []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["tokens_a"], np.uint64), np.frombuffer(r["tokens_b"], np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append((r["a"], r["b"]))
            yield _pairs(np.array(keep, np.int64).reshape(-1, 2))

    return materialize(both.mapInArrow(compare, "a long, b long"))


def _rooted(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node, root, component_id for every row of docs; components that share an id differ by root."""
    described = materialize(describe(docs, size, percent))
    full = described.filter("n > 0")
    least = materialize(full.groupBy("node").agg(F.min("doc_id").alias("least_id")))
    copies = materialize(full.select("node", "doc_id").join(least, "node").filter("doc_id > least_id").select("node", "doc_id").distinct())
    nodes = full.join(_few(copies), ["node", "doc_id"], "left_anti")  # one row a set, as far as ids tell rows apart

    rows = nodes.select("node", "n", F.posexplode("first").alias("place", "token"))
    leaders = (rows.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct("place", "n", "node")).alias("leader"))
               .filter("members > 1"))
    # Who cannot be near the leader by this token cannot be near any later member by it.
    met = materialize(rows.join(leaders, "token").filter(
        percent * (F.col("place") + F.col("leader.place")) <= (100 - percent) * (F.col("n") - F.col("place"))))
    star = met.filter(F.col("node") != F.col("leader.node")).filter(
        _near(F.col("n"), F.col("leader.n"), F.col("place"), F.col("leader.place"), percent)).select(
        F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()
    links = _verified(materialize(star), docs, nodes, size, percent)
    roots = materialize(connected_components(links))

    placed = met.join(roots, "node", "left").select("token", "place", "n", "node", F.coalesce("root", "node").alias("root"))
    open_groups = (placed.groupBy("token").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
                   .filter("low <> high").select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    # Block i of a group meets block j in cell (i, j): within (i, i) all pairs, elsewhere those of unlike sides.
    members = placed.join(open_groups, "token").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = materialize(members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    known = nodes.select("node", "histogram").join(_few(members.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"])
    cells = members.join(known, "node").select(
        "token", (F.least("side", "other").cast("long") * 2**31 + F.greatest("side", "other")).alias("cell"), "side",
        (F.col("side") == F.col("other")).alias("diagonal"), "place", "n", "node", "root", "histogram")
    near = _compare_groups(cells.repartition("token", "cell").sortWithinPartitions("token", "cell"), percent).distinct()
    more = _verified(materialize(near), docs, nodes, size, percent)
    roots = connected_components(links.union(more))
    labels = least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least_id")
    smallest = labels.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = materialize(labels.join(smallest, "root").select("node", "root", "component_id"))
    return described.select("doc_id", F.col("n").alias("n_shingles"), "node").join(of_node, "node", "left").select(
        "doc_id", "n_shingles", "node", "root",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text → doc_id, n_shingles, node, component_id for every row of docs."""
    return _rooted(docs, size, percent).select("doc_id", "n_shingles", "node", "component_id")


def keep_one_of_each(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """The rows of docs without near duplicates: of each component the one of the smallest id, unchanged.

    Rows without words stay. Rows that repeat the kept id within a component are reduced to one.
    An id that is missing or repeated tells no rows apart; there the set of the row's text decides.
    """
    found = materialize(_rooted(docs, size, percent))
    unclear = materialize(found.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("unclear")))
    gone = materialize(found.filter("doc_id > component_id").select(F.col("doc_id").alias("gone")).distinct())
    few_unclear, few_gone = _few(unclear), _few(gone)
    is_unclear = docs["doc_id"].eqNullSafe(few_unclear["unclear"])
    kept = docs.join(few_unclear, is_unclear, "left_anti").join(few_gone, docs["doc_id"] == few_gone["gone"], "left_anti")
    if not unclear.take(1):
        return kept
    # Of each component whose smallest id is unclear, one of the sets that stand under this id.
    least = found.filter("n_shingles > 0 and doc_id <=> component_id")
    chosen = materialize(least.join(few_unclear, least["doc_id"].eqNullSafe(few_unclear["unclear"]), "left_semi")
                         .groupBy("root").agg(F.min("node").alias("chosen"), F.min("doc_id").alias("least_id")).drop("root"))
    rows = docs.join(few_unclear, is_unclear, "left_semi")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    wrapped = rows.filter(has_words).select(F.struct("*").alias("row"), F.col("text").cast("binary").alias("text"))

    def name(batches):
        hashes = WordHashes()
        for batch in batches:
            nodes = [_node(shingle_set(hashes.of(text, lower=True), size)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64())], names=["row", "node"])

    named = wrapped.mapInArrow(name, T.StructType([wrapped.schema["row"], T.StructField("node", T.LongType())]))
    few_chosen = _few(chosen)
    mine = named.join(few_chosen, (F.col("node") == F.col("chosen")) & F.col("row.doc_id").eqNullSafe(F.col("least_id")))
    one = mine.groupBy("node").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row.*")
    return kept.unionByName(rows.filter(~has_words)).unionByName(one)
