"""Best-fit packing of tokenised documents into sequences of bounded length.

Bounded-space online best fit: a packer keeps a fixed number of open sequences in a bitset
keyed by free space; a piece goes where it leaves least, and when a new sequence is needed
beyond the number, the fullest closes. Packers are Spark tasks of equal, hash-dealt shares;
what a packer leaves open at its end goes, as one item each, to a second round of packers.

Defined cases: a null or empty text is one piece of the end id alone; a document longer than
a sequence is cut into whole sequences and a rest; rows that repeat a doc_id are documents of
their own; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catmatch.llm.common import materialize
from catmatch.llm.tokens import END_ID, ChunkIds, tokenizer_path

CAPACITY = 4096
OPEN_SEQUENCES = 2048
#: Pieces a packer looks at together, longest first: the online order within a packer.
WINDOW = 8192
#: Sequences that one packer fills, about; packers that one second-round packer follows.
PACKER_SEQUENCES, FOLLOWED = 16_384, 64
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, text → one row per piece: doc_id, piece, start, length, ids_crc32."""
    path = path or tokenizer_path()
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ChunkIds(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = ids_of.text(text or b"") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open sequences in a bitset: bit f is set while some open sequence has f tokens free."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.n_open, self.n_made = 0, 0, 0
        self.by_free: dict[int, list[tuple[int, list]]] = {}

    def _take(self, free: int) -> tuple[int, list]:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return found

    @staticmethod
    def _lowest(bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def add(self, length: int, item) -> Iterator[tuple[int, int, list]]:
        """Place an item of 1..capacity tokens; yields the sequences (number, free, items) that close."""
        fitting = self.bits >> length
        if fitting:
            free = length + self._lowest(fitting)
            number, items = self._take(free)
        else:
            if self.n_open >= self.most_open:
                fullest = self._lowest(self.bits)
                yield (*self._closed(fullest),)
            free, number, items = self.capacity, self.n_made, []
            self.n_made += 1
            self.n_open += 1
        items.append((item, self.capacity - free))
        free -= length
        if free:
            self.by_free.setdefault(free, []).append((number, items))
            self.bits |= 1 << free
        else:
            self.n_open -= 1
            yield number, 0, items

    def _closed(self, free: int) -> tuple[int, int, list]:
        number, items = self._take(free)
        self.n_open -= 1
        return number, free, items

    def rest(self) -> Iterator[tuple[int, int, list]]:
        while self.bits:
            yield self._closed(self._lowest(self.bits))


def _packed(rows: DataFrame, packers: int, order: list[str], capacity: int, most_open: int, window: int) -> DataFrame:
    """Adds packer, bin, offset, used and left_open to rows with a length of 1..capacity.

    Rows are dealt by hash and put in a fixed order, so a task run again gives the same result.
    """
    names = rows.columns
    n_at = names.index("length")
    dealt = (rows.withColumn("_deal", F.xxhash64(*order)).repartition(packers, "_deal")
             .sortWithinPartitions("_deal", *order).drop("_deal").withColumn("packer", F.spark_partition_id().cast("long")))
    schema = T.StructType([*dealt.schema.fields, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()),
                           T.StructField("used", T.LongType()), T.StructField("left_open", T.BooleanType())])
    out_names = [*names, "packer"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, most_open)
        out: list[tuple] = []
        arrow = None

        def emit(number, free, items, left_open):
            out.extend((*row, number, offset, capacity - free, left_open) for row, offset in items)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [*arrow.types, pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              names=[*out_names, "bin", "offset", "used", "left_open"])
            out.clear()
            return done

        def place(some: list[tuple]) -> None:
            some.sort(key=lambda row: -row[n_at])  # stable: ties stay in the fixed order
            for row in some:
                for closed in fit.add(row[n_at], row):
                    emit(*closed, False)

        waiting: list[tuple] = []
        for batch in batches:
            arrow = batch.schema
            waiting.extend(zip(*(c.to_pylist() for c in batch.columns)))
            while len(waiting) >= window:
                place(waiting[:window])
                del waiting[:window]
                if len(out) >= 10_000:
                    yield flush()
        place(waiting)
        for closed in fit.rest():
            emit(*closed, True)
        if out:
            yield flush()

    return dealt.mapInArrow(pack, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN_SEQUENCES, window: int = WINDOW,
                packer_sequences: int = PACKER_SEQUENCES, followed: int = FOLLOWED) -> DataFrame:
    """pieces (as of tokenize_pieces, materialised) with sequence_id and offset."""
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-tokens // (capacity * packer_sequences)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    first = materialize(_packed(pieces.select(columns), packers, ["doc_id", "piece", "length", "ids_crc32"], capacity, most_open, window))
    # What stayed open, one item a sequence, to the second round; its sequences are numbered apart.
    items = (first.filter("left_open").groupBy("packer", "bin").agg(F.max("used").alias("length"))
             .withColumnsRenamed({"packer": "from_packer", "bin": "from_bin"}))
    second = (_packed(items, max(1, packers // followed), ["from_packer", "from_bin"], capacity, most_open, window)
              .select(F.col("from_packer").alias("packer"), F.col("from_bin").alias("bin"),
                      F.struct(F.col("packer").alias("packer"), F.col("bin").alias("bin"), F.col("offset").alias("shift")).alias("moved")))
    joined = first.join(second, ["packer", "bin"], "left")
    number = lambda packer, bin_, later: packer * (1 << 34) + bin_ * 2 + later
    return joined.select(*columns,
                         F.when(F.col("moved").isNull(), number(F.col("packer"), F.col("bin"), F.lit(0)))
                         .otherwise(number(F.col("moved.packer"), F.col("moved.bin"), F.lit(1))).alias("sequence_id"),
                         (F.col("offset") + F.coalesce("moved.shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, text → doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(materialize(tokenize_pieces(docs, capacity, path)), capacity)
