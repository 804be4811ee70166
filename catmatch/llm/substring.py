"""Substring deduplication: remove words covered by windows whose word sequence starts elsewhere too.

Method: recompression. Rounds of globally consistent names for runs and pairs of words give
every window of `window` words an anchor, a high-level symbol that each equal window has as well
(recompression.py). Names are counted over the corpus; only stretches of windows whose anchor
is shared go on. Their windows are then named whole and counted in turn, which verifies the
repeats word for word. Equal texts are named once: of several copies, all windows repeat.

A name is a 64-bit hash of the words it stands for, as are the names of texts and windows.

Defined cases: a null text has no words; a text shorter than a window has none; rows that
repeat a doc_id or a text count each; a null doc_id is kept; an empty table gives no rows;
other columns are ignored, or kept by `remove_repeats`.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catmatch.llm.common import materialize
from catmatch.llm.recompression import window_anchors
from catmatch.llm.words import WordHashes, mix

WINDOW = 35
#: Keys up to this number (8 MB) may be broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_PIECE_WORDS = 250_000


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_text_key_", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _pieces(batch: pa.RecordBatch, hashes: WordHashes) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows with words, their first places, and all their words, some at a time."""
    rows, parts, total = [], [], 0
    for row, text in enumerate(batch.column(1).to_pylist()):
        words = hashes.of(text)
        if len(words):
            rows.append(row)
            parts.append(words)
            total += len(words)
        if total >= _PIECE_WORDS:
            yield rows, np.r_[0, np.cumsum([len(p) for p in parts])[:-1]].astype(np.int64), np.concatenate(parts)
            rows, parts, total = [], [], 0
    if rows:
        yield rows, np.r_[0, np.cumsum([len(p) for p in parts])[:-1]].astype(np.int64), np.concatenate(parts)


def anchor_stretches(texts: DataFrame, window: int) -> DataFrame:
    """_text_key_, text → name, _key, begin, length: stretches of window starts whose windows share an anchor of that name."""
    def stretches(batches):
        hashes = WordHashes()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for rows, first, words in _pieces(batch, hashes):
                found = window_anchors(words, first, window)
                of = np.searchsorted(first, found.window, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.name.view(np.int64)), pa.array(keys[np.array(rows)[of]]),
                     pa.array((found.window - first[of]).astype(np.int32)), pa.array((found.end - found.window).astype(np.int32))],
                    names=["name", "_text_key_", "begin", "length"])

    return texts.select("_text_key_", F.col("text").cast("binary")).mapInArrow(stretches, "name long, _text_key_ long, begin int, length int")


def window_names(texts: DataFrame, window: int) -> DataFrame:
    """_text_key_, text, stretches (begin << 32 | length) → name, _key, start for every window of the stretches."""
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))

    def windows(batches):
        hashes = WordHashes()
        for batch in batches:
            keys, stretches = batch.column(0).to_numpy(), batch.column(2)
            for rows, first, words in _pieces(batch, hashes):
                n = len(words)
                power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
                back = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])
                sums = np.r_[np.uint64(0), np.cumsum(mix(words, 9) * power[:-1])]
                packed = [stretches[row].values.to_numpy() for row in rows]
                of = np.repeat(np.arange(len(rows)), [len(p) for p in packed])
                packed = np.concatenate(packed)
                begin, length = packed >> 32, packed & 0xFFFFFFFF
                of = np.repeat(of, length)
                start = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
                at = start + first[of]
                names = mix((sums[at + window] - sums[at]) * back[at], 10)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(keys[np.array(rows)[of]]), pa.array(start.astype(np.int32))],
                    names=["name", "_text_key_", "start"])

    return (texts.select("_text_key_", F.col("text").cast("binary"), "stretches")
            .mapInArrow(windows, "name long, _text_key_ long, start int"))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose name occurs twice or more. Counts meet before the shuffle; a hot name's rows are split by the join."""
    names = rows.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    return rows.join(names, "name")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct text with repeated windows: _key, copies (rows of the text), starts (of windows, as stretches)."""
    keyed = _keyed(docs.select("doc_id", "text"))
    texts = materialize(keyed.groupBy("_text_key_").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")))
    again = materialize(keyed.select("_text_key_", "doc_id").join(texts.filter("copies > 1"), "_text_key_").filter("doc_id > least")
                        .select("_text_key_", "doc_id").distinct())
    once = keyed.join(_few(again), ["_text_key_", "doc_id"], "left_anti").select("_text_key_", "text")

    pack = lambda begin, length: F.shiftleft(begin.cast("long"), 32).bitwiseOR(length.cast("long"))
    stretches = (_shared(anchor_stretches(once, window)).groupBy("_text_key_")
                 .agg(F.collect_list(pack(F.col("begin"), F.col("length"))).alias("stretches")))
    windows = _shared(window_names(once.join(stretches, "_text_key_"), window))
    starts = windows.groupBy("_text_key_").agg(F.collect_set("start").alias("starts"))
    copied = texts.filter("copies > 1").select("_text_key_", "copies")
    return copied.join(starts, "_text_key_", "full_outer").select("_text_key_", F.coalesce("copies", F.lit(1)).alias("copies"), "starts")


def _covered(n: int, copies: int, starts: list[int] | None, window: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    if n < window:
        return np.zeros(n, bool)
    if copies > 1:
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int64)
    starts = np.asarray(starts or [], np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return np.cumsum(edge[:n]) > 0


def _with_repeats(docs: DataFrame, repeats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (with _key) that no repeat touches, and the others joined with _copies_ and _starts_.

    Where the touched keys are few enough, only the touched rows are shuffled.
    """
    repeats = materialize(repeats)
    repeats = repeats.select("_text_key_", F.col("copies").alias("_copies_"), F.col("starts").alias("_starts_"))
    keys = _few(repeats.select("_text_key_"))
    keyed = _keyed(docs)
    return keyed.join(keys, "_text_key_", "left_anti"), keyed.join(keys, "_text_key_", "left_semi").join(repeats, "_text_key_")


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) for every row."""
    free, touched = _with_repeats(docs.select("doc_id", "text"), repeated_windows(docs, window))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def digest(batches):
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for doc_id, text, copies, starts in zip(*columns):
                words = (text or b"").split()
                gone = _covered(len(words), copies, starts, window)
                kept = [w for w, g in zip(words, gone) if not g] if gone.any() else words
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("binary")]
    free = free.select(*columns, F.lit(1).alias("copies"), F.lit(None).cast("array<int>").alias("starts"))
    touched = touched.select(*columns, F.col("_copies_").cast("int").alias("copies"), F.col("_starts_").alias("starts"))
    return free.mapInArrow(digest, schema).union(touched.mapInArrow(digest, schema))


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the words marked, and without the white space behind each of them."""
    raw = text.encode("utf-8")
    out, at = [], 0
    for word, dropped in zip(raw.split(), gone):
        begin = raw.index(word, at)
        out.append(raw[at:begin])
        if not dropped:
            out.append(word)
        at = begin + len(word)
        if dropped:
            while at < len(raw) and raw[at:at + 1].isspace():
                at += 1
    out.append(raw[at:])
    return b"".join(out).decode("utf-8").rstrip(" \t\n\x0b\f\r") if gone.any() else text


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with the repeated words cut out of `text`; n_chars, if there is one, counts anew."""
    free, touched = _with_repeats(docs, repeated_windows(docs, window))

    def cut(batches):
        for batch in batches:
            rest = batch.drop_columns(["_copies_", "_starts_"])
            texts = []
            for text, copies, starts in zip(*(batch.column(c).to_pylist() for c in ("text", "_copies_", "_starts_"))):
                texts.append(None if text is None else cut_text(text, _covered(len(text.encode("utf-8").split()), copies, starts, window)))
            at = rest.schema.get_field_index("text")
            yield rest.set_column(at, "text", pa.array(texts, pa.string()))

    names = docs.columns
    touched = touched.select(*names, F.col("_copies_").cast("int").alias("_copies_"), "_starts_")
    changed = touched.mapInArrow(cut, docs.schema)
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return free.select(*names).unionByName(changed.select(*names))
