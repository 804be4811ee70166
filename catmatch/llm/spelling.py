"""Spelling variant grouping: words one edit apart, their commoner form, and the root that forms lead to.

K-d trees over letter-count vectors. A vector counts the letters of a word and, in a second block,
those of its first half, which tells anagrams apart. One edit moves either block by two at most:
one letter's count goes up by one, and one letter's count down by one (a replacement), or the
first of these alone in the whole word (an insertion). So a range search leaves out every box that
asks for more, and letter order decides what is left.

The searches run per length pair, words among words of their own length and of one letter more.
Trees over a bounded sample of the vocabulary, one a length, cut it into leaves. A word lives in one
leaf and visits every other leaf that its range reaches, so that each pair of words meets once.
Inside a leaf a tree over its words does the same again down to a few dozen words. A leaf gives, for
each word, how many near words it saw and the commonest of them: no table of pairs is made.

Counting: words are counted inside tasks first, then by Spark. `slip_every` can plant slips: of a run
of letters whose crc32 of `<doc_id>:<run>` it divides one letter is dropped, the same in all its places
in the document.

Defined cases: a null or empty text has no words; a null doc_id reads as an empty one; rows that repeat a doc_id
count each; of near words equally common the first in code-point order is the form; an empty table gives no rows;
other columns are ignored.
"""
from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catmatch.llm.common import materialize

LEAST_CHARS, LEAST_COUNT = 5, 3
#: A form is at least so many times as common as the word.
COMMONER = 2
#: Words of the vocabulary that the routing trees are built from, words a leaf should hold, and sampled words it should have.
SAMPLE, LEAF_WORDS, LEAF_SAMPLE = 65_536, 4_000, 16
#: Words in the smallest boxes, and cells of letters compared at once.
BOX_WORDS, CELLS = 32, 1 << 22
_HELD_WORDS = 200_000
_LETTERS = 26 + 64
#: Latin-1 bytes → lower-case A to Z, the letters from U+00C0, and a space for everything else.
_LETTER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_INDEX = np.array([b - 97 if 97 <= b <= 122 else b - 0xC0 + 26 if b >= 0xC0 else 0 for b in range(256)], np.int64)


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slip_every: int | None = None) -> DataFrame:
    """word (its letters as Latin-1 bytes), n: the vocabulary of all texts."""
    def count(batches):
        totals: dict[bytes, int] = defaultdict(int)

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])
            totals.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = Counter((text or "").encode("latin-1", "replace").translate(_LETTER).split())
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs.items():
                    if slip_every:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
                        if h % slip_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                    if len(run) >= least_chars:
                        totals[run] += n
                if len(totals) >= _HELD_WORDS:
                    yield flush()
        if totals:
            yield flush()

    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as a matrix of bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _vectors(letters: np.ndarray, cut: int) -> np.ndarray:
    """Letter counts of whole words, and then those of their first `cut` letters."""
    n = len(letters)
    flat = _INDEX[letters] + np.arange(n)[:, None] * _LETTERS
    count = lambda part: np.bincount(part.ravel(), minlength=n * _LETTERS).reshape(n, _LETTERS).astype(np.int32)
    return np.hstack([count(flat), count(flat[:, :cut])])


class Reach(NamedTuple):
    """By how much counts may be higher and lower in a box than in the word that searches it, by block."""
    up: tuple[int, int]
    down: tuple[int, int]


SAME, LONGER = Reach((1, 1), (1, 1)), Reach((1, 1), (0, 1))


class Tree(NamedTuple):
    """Inner nodes hold a dimension, the largest value of their left side, and their children; a negative child is leaf -1 - child."""
    nodes: list[tuple[int, int, int, int]]
    leaves: list[np.ndarray]  # the rows of each leaf

    def root(self) -> int:
        return 0 if self.nodes else -1


def build_tree(vectors: np.ndarray, most: float) -> Tree:
    """A tree whose leaves hold at most `most` rows, or rows that are all alike."""
    tree = Tree([], [])

    def grow(rows: np.ndarray) -> int:
        if len(rows) > most:
            here = vectors[rows]
            dim = int(here.var(axis=0).argmax())
            values = here[:, dim]
            low, high = values.min(), values.max()
            if low < high:
                at = min(int(np.median(values)), int(high) - 1)
                number = len(tree.nodes)
                tree.nodes.append((dim, at, 0, 0))
                tree.nodes[number] = (dim, at, grow(rows[values <= at]), grow(rows[values > at]))
                return number
        tree.leaves.append(rows)
        return -len(tree.leaves)

    grow(np.arange(len(vectors)))
    return tree


def home_leaves(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf each vector falls in."""
    out = np.zeros(len(vectors), np.int64)
    todo = [(tree.root(), np.arange(len(vectors)))]
    while todo:
        number, rows = todo.pop()
        if number < 0:
            out[rows] = -1 - number
        elif len(rows):
            dim, at, left, right = tree.nodes[number]
            low = vectors[rows, dim] <= at
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def range_search(tree: Tree, vectors: np.ndarray, reach: Reach) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, the vectors whose range reaches its box)."""
    if not len(vectors):
        return
    bounds: dict[int, tuple[float, float]] = {}

    def go(number: int, rows: np.ndarray, up: np.ndarray, down: np.ndarray):
        # up and down: what the box asks of each row so far, by block
        if not len(rows):
            return
        if number < 0:
            yield -1 - number, rows
            return
        dim, at, left, right = tree.nodes[number]
        block = dim // _LETTERS
        values = vectors[rows, dim]
        low, high = bounds.get(dim, (-np.inf, np.inf))
        asked = down[:, block] + np.maximum(values - at, 0) - np.maximum(values - high, 0)
        fits = asked <= reach.down[block]
        less = down[fits]
        less[:, block] = asked[fits]
        bounds[dim] = (low, at)
        yield from go(left, rows[fits], up[fits], less)
        asked = up[:, block] + np.maximum(at + 1 - values, 0) - np.maximum(low - values, 0)
        fits = asked <= reach.up[block]
        more = up[fits]
        more[:, block] = asked[fits]
        bounds[dim] = (at + 1, high)
        yield from go(right, rows[fits], more, down[fits])
        bounds[dim] = (low, high)

    nothing = np.zeros((len(vectors), 2))
    yield from go(tree.root(), np.arange(len(vectors)), nothing, nothing.copy())


def _one_edit(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """For rows of letters side by side, of one length or of one letter less: whether one edit parts them."""
    n = shorter.shape[-1]
    if longer.shape[-1] == n:
        return (longer != shorter).sum(-1) == 1
    ahead, behind = longer[..., :n] != shorter, (longer[..., 1:] != shorter)[..., ::-1]
    first = lambda differs: np.where(differs.any(-1), differs.argmax(-1), n)
    return first(ahead) + first(behind) >= n


def near_pairs(home: np.ndarray, tree: Tree, guests: np.ndarray, vectors: np.ndarray, reach: Reach) -> tuple[np.ndarray, np.ndarray]:
    """(row of home, row of guests) of words one edit apart."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for leaf, rows in range_search(tree, vectors, reach):
        here = tree.leaves[leaf]
        step = max(1, CELLS // max(1, len(here) * home.shape[1]))
        for begin in range(0, len(rows), step):
            some = rows[begin:begin + step]
            for low in range(0, len(here), 4096):  # boxes of words with equal counts can be larger
                part = here[low:low + 4096]
                at, of = np.nonzero(_one_edit(home[part][:, None], guests[some][None]))
                found.append((part[at], some[of]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _best(of: np.ndarray, words: list[bytes], other: np.ndarray, others: list[bytes], counts: np.ndarray) -> list[list]:
    """word, n_near, form_n, form for every word with near ones. `others` are in code-point order."""
    order = np.lexsort((other, -counts[other], of))
    of, other = of[order], other[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(of)])
    return [[words[i] for i in of[first]], n, counts[other[first]], [others[i] for i in other[first]]]


class _Leaf:
    """The words of a leaf, and the near words that its own and its visiting words find there."""

    def __init__(self, length: int, words: list[bytes], counts: list[int]):
        self.length, self.words, self.counts = length, words, np.array(counts, np.int64)
        self.letters = _letters(words) if words else np.zeros((0, length), np.uint8)
        self.vectors = _vectors(self.letters, length // 2) if words else np.zeros((0, 2 * _LETTERS), np.int32)
        self.tree = build_tree(self.vectors, BOX_WORDS)

    def own(self) -> list[list[list]]:
        one, two = near_pairs(self.letters, self.tree, self.letters, self.vectors, SAME)
        return [_best(one, self.words, two, self.words, self.counts)]

    def visited(self, guests: list[bytes], counts: list[int]) -> list[list[list]]:
        out = []
        for length, reach in ((self.length, SAME), (self.length - 1, LONGER)):
            some = [i for i, w in enumerate(guests) if len(w) == length]
            if some and self.words:
                words, n = [guests[i] for i in some], np.array([counts[i] for i in some], np.int64)
                letters = _letters(words)
                one, two = near_pairs(self.letters, self.tree, letters, _vectors(letters, self.length // 2), reach)
                out += [_best(one, self.words, two, words, n), _best(two, words, one, self.words, self.counts)]
        return out


def routing_trees(vocabulary: DataFrame, sample: int = SAMPLE, leaf_words: int = LEAF_WORDS) -> dict[int, Tree]:
    """length → tree over a sample of the vocabulary, about `sample` words drawn by hash; without its rows."""
    total = vocabulary.count()
    share = min(1.0, sample / max(1, total))
    drawn = vocabulary.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int(share * (1 << 40))).select("word").toArrow().column(0).to_pylist()
    by_length = defaultdict(list)
    for word in drawn:
        by_length[len(word)].append(word)
    most = max(leaf_words * share, min(LEAF_SAMPLE, leaf_words))
    out = {}
    for length, words in by_length.items():
        tree = build_tree(_vectors(_letters(sorted(words)), length // 2), most)
        if tree.nodes:
            out[length] = Tree(tree.nodes, [])
    return out


def leaf_rows(vocabulary: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """length and leaf, guest (0 for the words that live there, 1 for those that visit), word, n."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(trees)
    alone = Tree([], [])

    def route(batches):
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in words])
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                letters = _letters([words[i] for i in rows])
                own = sent.value.get(length, alone)
                vectors = _vectors(letters, length // 2)
                home = home_leaves(own, vectors)
                parts = [(length, home, 0, np.arange(len(rows)))]
                for leaf, some in range_search(own, vectors, SAME):
                    some = some[home[some] < leaf]
                    parts.append((length, np.full(len(some), leaf), 1, some))
                longer = sent.value.get(length + 1, alone)
                if length % 2:
                    vectors = _vectors(letters, (length + 1) // 2)
                parts += [(length + 1, np.full(len(some), leaf), 1, some) for leaf, some in range_search(longer, vectors, LONGER)]
                for size, leaf, guest, some in parts:
                    for begin in range(0, len(some), 10_000):
                        at = some[begin:begin + 10_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), size, np.int32)), pa.array(leaf[begin:begin + 10_000].astype(np.int32)),
                             pa.array(np.full(len(at), guest, np.int32)), pa.array([words[rows[i]] for i in at], pa.binary()), pa.array(counts[rows[at]])],
                            names=["length", "leaf", "guest", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(route, "length int, leaf int, guest int, word binary, n long")


def near_words(vocabulary: DataFrame, sample: int = SAMPLE, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """word, n_near, form_n, form (the commonest near word) for every word with near ones."""
    rows = leaf_rows(vocabulary, routing_trees(vocabulary, sample, leaf_words))
    names = ["word", "n_near", "form_n", "form"]

    def search(batches):
        def made(parts):
            for words, n_near, form_n, forms in parts:
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n_near, pa.int64()), pa.array(form_n, pa.int64()),
                                                      pa.array(forms, pa.binary())], names=names)

        key, leaf, words, counts = None, None, [], []
        for batch in batches:
            length, place, guest = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((np.diff(length) != 0) | (np.diff(place) != 0) | (np.diff(guest) != 0)) + 1
            for begin, end in zip(np.r_[0, edges].tolist(), np.r_[edges, len(length)].tolist()):
                if begin == end:
                    continue
                if key != (length[begin], place[begin]):
                    if leaf is None and words:
                        yield from made(_Leaf(int(key[0]), words, counts).own())
                    key, leaf, words, counts = (length[begin], place[begin]), None, [], []
                some, n = batch.column(3).slice(begin, end - begin).to_pylist(), batch.column(4).slice(begin, end - begin).to_pylist()
                if not guest[begin]:
                    words, counts = words + some, counts + n
                    continue
                if leaf is None:
                    leaf = _Leaf(int(key[0]), words, counts)
                    if words:
                        yield from made(leaf.own())
                yield from made(leaf.visited(some, n))
        if leaf is None and words:
            yield from made(_Leaf(int(key[0]), words, counts).own())

    seen = rows.repartition("length", "leaf").sortWithinPartitions("length", "leaf", "guest", "word")
    found = seen.mapInArrow(search, "word binary, n_near long, form_n long, form binary")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
            .select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, form → word, root: the last word that forms lead to. Each round follows twice as many; forms have no circles."""
    ways = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not ways.filter("moved").isEmpty():
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = materialize(ways.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return ways.select("word", "root")


def spelling_groups(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, commoner: int = COMMONER,
                    slip_every: int | None = None, sample: int = SAMPLE, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    vocabulary = materialize(word_counts(docs, least_chars, least_count, slip_every))
    near = near_words(vocabulary, sample, leaf_words)
    commonest = F.col("form_n") >= commoner * F.col("n")
    judged = materialize(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(commonest, F.col("form")).alias("form"),
        F.when(commonest, F.col("form_n")).alias("form_n")))
    text = lambda c: F.decode(c, "ISO-8859-1")
    return (judged.join(roots(judged.filter("form is not null")), "word", "left")
            .select(text("word").alias("word"), text("form").alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n"))
