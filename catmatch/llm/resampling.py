"""Target-distribution importance resampling: documents drawn by how much their n-grams look like a target's.

Features are all runs of one to `size` consecutive words; a crc32 puts them in buckets. A bucket's gain is the
log of its share among the target's features against its share among the corpus's, both smoothed by
one per bucket; a document's weight is the sum of gains over its features. Adding Gumbel noise from
the document's id and taking the highest scores draws without replacement, in proportion to the
weights.

Segment deduplication: newlines cut texts into lines. Equal lines are counted by Spark, the features of a
distinct line are made once and multiplied by its occurrences, and the n-grams that cross lines are
added from the words at the lines' ends. Scoring does likewise: a task makes a line's gain once, as
long as its cache holds it. The crc32 of an n-gram is put together from those of its words, whose
appending is linear over bits, so that no n-gram is ever spelled out.

Ranks come from range partitions of the scores: a partition's rows are numbered in order and shifted
by the sizes of those before, so no task holds all drawn documents.

Defined cases: a null or empty text has no features, weight 0 and no rank; a null id draws as an empty
one and comes after others of its score; rows that repeat an id and a score are ranked one after another, those with fewer
features first; an empty target or corpus has no features to tell buckets apart; an empty table gives no rows; other columns are
ignored, or kept by `resample`.
"""
from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catmatch.llm.common import materialize

BUCKETS, SIZE = 10_000, 3
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
SCALE = 1000
#: Words that a task remembers, bytes of lines (an entry more takes about so many), and words it works on at once.
_WORDS, _HELD_BYTES, _ENTRY, _PIECE_WORDS = 250_000, 32 << 20, 150, 250_000
#: Bytes of words: digits, a to z (A to Z become these) and everything from 0x80. Newlines stay, the rest is space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 or b == 10 else 32 for b in range(256))


def _zero_bytes(powers: int) -> np.ndarray:
    """tables[k, j, v]: what byte j of value v of a crc32 register becomes when 2 ** k zero bytes follow."""
    values = np.arange(256, dtype=np.uint32)
    step = values.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    follow = lambda table, x: table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]
    one = np.stack([step[values], *[(values << np.uint32(8 * j)) >> np.uint32(8) for j in (1, 2, 3)]])
    tables = [one]
    for _ in range(powers - 1):
        tables.append(np.stack([follow(tables[-1], row) for row in tables[-1]]))
    return np.stack(tables)


_POWERS = 32
_AFTER = _zero_bytes(_POWERS)


def appended(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of joined byte strings from the crc32 of both parts and the length of the second."""
    out = left.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        some = np.flatnonzero(length >> k & 1)
        x, table = out[some], _AFTER[k]
        out[some] = table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]
    return out ^ right


class Words(dict):
    """word → its number; arrays of crc32, of crc32 with a space behind, and of lengths by number. `fresh` forgets all."""

    def __init__(self):
        super().__init__()
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.plain, self.spaced, self.length = [], [], []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.plain)
        crc = zlib.crc32(word)
        self.plain.append(crc)
        self.spaced.append(zlib.crc32(b" ", crc))
        self.length.append(len(word))
        return number

    def grams(self, words: list[bytes], segment: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words in a run, where runs begin, their crc32) for all runs inside one segment, by length."""
        if len(self) > _WORDS:
            self.fresh()
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        plain, spaced = np.array(self.plain, np.uint32)[number], np.array(self.spaced, np.uint32)[number]
        length = np.array(self.length, np.int64)[number]
        at, open_ = np.arange(len(words)), spaced
        yield 1, at, plain
        for n in range(2, size + 1):
            at = at[at + n - 1 < len(words)]
            at = at[segment[at] == segment[at + n - 1]]
            yield n, at, appended(open_[at], plain[at + n - 1], length[at + n - 1])
            if n < size:
                longer = np.zeros(len(words), np.uint32)
                longer[at] = appended(open_[at], spaced[at + n - 1], length[at + n - 1] + 1)
                open_ = longer


def _edges(lines: list[bytes], size: int) -> tuple[list[bytes], list[int]]:
    """Words near the ends of a document's lines, as runs across lines need them, and the line of each."""
    words, of = [], []
    for k, line in enumerate(lines):
        found = line.split(None, 2 * size - 2)
        if len(found) > 2 * size - 2:
            found = found[:size - 1] + line.rsplit(None, size - 1)[1 - size:]
        words += found
        of += [k] * len(found)
    return words, of


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split(b"\n")


def crossing_buckets(texts: list[list[bytes]], words: Words, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every run of words that lies in two or more lines of a text."""
    parts, lines, first = [], [], [0]
    for k, rows in enumerate(texts):
        some, of = _edges(rows, size) if len(rows) > 1 else ([], [])
        parts += some
        lines += of
        first.append(len(parts))
    if size < 2 or not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, line = np.repeat(np.arange(len(texts)), np.diff(first)), np.array(lines)
    found = [(owner[at[c]], crc[c] % buckets) for n, at, crc in words.grams(parts, owner, size) if n > 1 for c in [line[at] != line[at + n - 1]]]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)


def line_buckets(lines: list[bytes], words: Words, size: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, bucket) of every run of words inside a line, by the length of the runs."""
    split = [line.split() for line in lines]
    owner = np.repeat(np.arange(len(lines)), [len(s) for s in split])
    for _, at, crc in words.grams([w for s in split for w in s], owner, size):
        yield owner[at], (crc % buckets).astype(np.int64)


def feature_counts(docs: DataFrame, buckets: int = BUCKETS, size: int = SIZE) -> np.ndarray:
    """Features of all texts by bucket. The driver gets a sum per bucket."""
    def segments(batches):
        words, held, size_held, across = Words(), {}, 0, np.zeros(buckets, np.int64)

        def flush():
            for begin in range(0, len(lines := list(held)), 10_000):
                some = lines[begin:begin + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(np.full(len(some), -1, np.int32)),
                                                  pa.array([held[x] for x in some], pa.int64())], names=["line", "bucket", "n"])
            held.clear()

        for batch in batches:
            for texts in _some(batch.column(0).to_pylist()):
                for rows in texts:
                    for line in rows:
                        if line not in held:
                            size_held += len(line) + _ENTRY
                        held[line] = held.get(line, 0) + 1
                across += np.bincount(crossing_buckets(texts, words, size, buckets)[1], minlength=buckets)
                if size_held > _HELD_BYTES:
                    yield from flush()
                    size_held = 0
        yield from flush()
        some = np.flatnonzero(across)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.array(across[some])],
                                         names=["line", "bucket", "n"])

    def multiplied(batches):
        words, total = Words(), np.zeros(buckets, np.int64)
        for batch in batches:
            lines, bucket, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            np.add.at(total, bucket[bucket >= 0], n[bucket >= 0])
            for some, counts in _pieces([x for x in lines if x is not None], n[bucket < 0]):
                for of, found in line_buckets(some, words, size, buckets):
                    np.add.at(total, found, counts[of])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    lines = (docs.select(F.col("text").cast("binary")).mapInArrow(segments, "line binary, bucket int, n long")
             .groupBy("line", "bucket").agg(F.sum("n").alias("n")))
    found = lines.mapInArrow(multiplied, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def _some(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The lines of texts, some texts at a time."""
    held, size = [], 0
    for text in texts:
        held.append(_lines(text))
        size += len(text or b"")
        if size > 6 * _PIECE_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pieces(lines: list[bytes], counts: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray]]:
    begin, size = 0, 0
    for k, line in enumerate(lines):
        size += len(line)
        if size > 6 * _PIECE_WORDS or k == len(lines) - 1:
            yield lines[begin:k + 1], counts[begin:k + 1]
            begin, size = k + 1, 0


def bucket_gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> list[int]:
    """floor(scale * ln of the smoothed share among the target's features over that among the corpus's), by bucket."""
    own, wanted, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return [math.floor(scale * math.log((float(t) + 1) * (own + n) / ((float(s) + 1) * (wanted + n)))) for s, t in zip(corpus, target)]


def noise(seed: int, doc_id: str | None, scale: int = SCALE) -> int:
    """Gumbel noise of a document: fixed by its id and the seed."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: list[int], size: int = SIZE, seed: int = SEED) -> DataFrame:
    """The rows of docs as struct `row`, with n_words, n_features, weight and score."""
    buckets, wrapped = len(gains), docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("string").alias("name"),
                                               F.col("text").cast("binary").alias("text"))
    names = ["row", "n_words", "n_features", "weight", "score"]
    out = T.StructType([wrapped.schema["row"], *[T.StructField(c, T.LongType()) for c in names[1:]]])

    def judge(batches):
        gain, words, known, size_known = np.array(gains, np.int64), Words(), {}, 0

        def learn(lines: list[bytes]) -> None:
            for some, _ in _pieces(lines, np.zeros(len(lines))):
                total = np.zeros(len(some), np.int64)
                for of, bucket in line_buckets(some, words, size, buckets):
                    np.add.at(total, of, gain[bucket])
                known.update(zip(some, zip(total.tolist(), [len(x.split()) for x in some])))

        for batch in batches:
            n_words, weight = [], []
            for texts in _some(batch.column(2).to_pylist()):
                if size_known > _HELD_BYTES:
                    known.clear()
                    size_known = 0
                fresh = list({line for rows in texts for line in rows if line not in known})
                size_known += sum(map(len, fresh)) + _ENTRY * len(fresh)
                learn(fresh)
                of, bucket = crossing_buckets(texts, words, size, buckets)
                across = np.zeros(len(texts), np.int64)
                np.add.at(across, of, gain[bucket])
                for rows, more in zip(texts, across.tolist()):
                    found = [known[line] for line in rows]
                    weight.append(more + sum(f[0] for f in found))
                    n_words.append(sum(f[1] for f in found))
            n_features = [sum(max(n - k, 0) for k in range(size)) for n in n_words]
            score = [w + noise(seed, i) for w, i in zip(weight, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (n_words, n_features, weight, score)]], names=names)

    return wrapped.mapInArrow(judge, out)


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rank (1, 2, ... by score; null if not drawn) for scored rows; `percent` of those with enough words are drawn."""
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("row.doc_id").asc_nulls_last(), F.col("n_features")]
    placed = materialize(rows.filter(fit).repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("place", F.monotonically_increasing_id()))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # a row per partition
    most = sum(n for _, n in sizes) * percent // 100
    before, starts = 0, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + at + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= most, rank))
    return ranked.drop("part", "before", "place").unionByName(rows.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def importance_draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
                    buckets: int = BUCKETS, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs, drawn to look like the texts of target."""
    gains = bucket_gains(feature_counts(docs, buckets, size), feature_counts(target, buckets, size))
    rows = materialize(scored(docs.select("doc_id", "text"), gains, size, seed).select(
        F.struct("row.doc_id").alias("row"), "n_words", "n_features", "weight", "score"))
    return drawn(rows, percent, least_words).select("row.doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, size: int = SIZE) -> DataFrame:
    """The drawn rows of docs, unchanged. Scores are made again to cut at the last drawn one, so no text is shuffled;
    rows that repeat its id, score and number of features are kept with it."""
    gains = bucket_gains(feature_counts(docs, buckets, size), feature_counts(target, buckets, size))
    rows = scored(docs, gains, size, seed)
    ranked = drawn(rows.select(F.struct("row.doc_id").alias("row"), "n_words", "n_features", "weight", "score"), percent, least_words)
    last = ranked.filter("rank is not null").agg(F.max(F.struct("rank", "score", "row.doc_id", "n_features")).alias("last")).first()["last"]
    if last is None:
        return docs.limit(0)
    here, bar = F.col("row.doc_id"), F.lit(last["doc_id"])
    before = here.isNotNull() if last["doc_id"] is None else here < bar
    same = here.eqNullSafe(bar) & (F.col("n_features") <= last["n_features"])
    tied = (F.col("score") == last["score"]) & (F.coalesce(before, F.lit(False)) | same)
    return rows.filter((F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | tied)).select("row.*")
