"""Spelling variants against brute force: counting, trees, near words, forms and roots."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from catmatch.llm import spelling
from catmatch.llm.queries import QUERIES
from conftest import SMALL

from catmatch.llm.common import table


def counted(rows, slip=None, least=3):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= least}


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1:]
        if i < len(word):
            yield word[:i] + word[i + 1:]


def grouped(counts):
    letters = sorted(set("".join(counts)))
    near = {w: sorted({e for e in edits(w, letters) if e in counts and e != w}, key=lambda e: (-counts[e], e)) for w in counts}
    form = {w: near[w][0] if near[w] and counts[near[w][0]] >= 2 * counts[w] else None for w in counts}
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    found = QUERIES["op12_spelling_groups"](spark, SMALL)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = list(map(tuple, found.collect()))
    assert len(found) == len(set(found)) and set(found) == grouped(counted(rows, 97))
    assert any(r[1] for r in found)


@pytest.mark.parametrize("leaf_words, sample", [(4_000, 65_536), (20, 65_536), (20, 200), (1, 100)])
def test_dense_words_in_small_leaves(spark, documents, leaf_words, sample):
    made = random.Random(leaf_words + sample)
    words = ["".join(made.choice("abÀ") for _ in range(made.choice([5, 6, 6, 7, 30]))) for _ in range(500)]
    for word in words[:100]:
        words += [word] * made.randrange(12) + ["é" + word, word[:3] + word[4:]] * 2
    rows = [(i % 7, " ".join(words[i::9])) for i in range(9)] * 3
    found = spelling.spelling_groups(documents(rows), slip_every=13, leaf_words=leaf_words, sample=sample).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, grouped(counted(rows, 13))))


def test_edge_rows(spark, documents, edge_rows):
    chain = " ".join(["aaaaaaaaa"] * 48 + ["aaaaaaaab"] * 24 + ["aaaaaaabb"] * 12 + ["aaaaaabbb"] * 6 + ["aaaaabbbb"] * 3)
    rows = [*edge_rows, (None, "nobody nobody nobody Nobody"), (None, chain), (14, "x" * 100_000 + " " + "x" * 100_001), (14, "×÷×÷× ÀÉÎÕÜ"), (14, "×÷×÷× àÉÎÕÜ")]
    rows += rows[-2:] * 2 + [(14, "x" * 100_000), (14, "x" * 100_001)] * 2
    found = list(map(tuple, spelling.spelling_groups(documents(rows)).collect()))
    assert sorted(map(str, found)) == sorted(map(str, grouped({w: n for w, n in counted(rows).items() if len(w) < 1000})
                                                | {("x" * 100_000, None, "x" * 100_000, 3, 1, None), ("x" * 100_001, None, "x" * 100_001, 3, 1, None)}))
    assert {r[0]: r[2] for r in found}["aaaaabbbb"] == "aaaaaaaaa"
    assert spelling.spelling_groups(documents([])).collect() == []
    assert spelling.spelling_groups(documents(rows[:3])).collect() == []


def test_searches_leave_boxes_out():
    made = random.Random(5)
    words = sorted({"".join(made.choice("abcdefghij") for _ in range(9)) for _ in range(4000)})
    letters = spelling._letters([w.encode() for w in words])
    vectors = spelling._vectors(letters, 4)
    tree = spelling.build_tree(vectors, 32)
    reached = sum(len(tree.leaves[leaf]) * len(rows) for leaf, rows in spelling.range_search(tree, vectors, spelling.SAME))
    assert reached < 0.2 * len(words) ** 2
    one, two = spelling.near_pairs(letters, tree, letters, vectors, spelling.SAME)
    apart = (letters[:, None] != letters[None]).sum(-1) == 1
    assert set(zip(one.tolist(), two.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(apart))))
