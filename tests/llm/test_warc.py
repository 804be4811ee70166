"""WARC archives: round trips, kinds of records, and what the salvage reader finds in damaged files."""
import gzip
import hashlib
import random

import pytest
from catmatch.llm import warc
from catmatch.llm.common import shared_folder
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "page_id long, url string, html string, digest string, member int, size int, again int, first int, key int, name string, body int"


def _written(spark, rows, tmp, **more):
    pages = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, "y", 6) for r in rows], SCHEMA).repartition(3)
    folder = f"{shared_folder(spark)}/{tmp.name}"
    warc.write_archives(pages, folder, "page_id", **more)
    return warc.read_archives(spark, folder), folder


def test_edge_rows_round_trip(spark, tmp_path):
    long, same = "é<p>" * 200_000, "same text " * 20
    rows = [(1, "http://a/", same), (2, None, same), (0, "http://b/", same), (None, "http://c/", same), (0, "http://d/\r\nX: 1", same),
            (5, "", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (9, "u", long), (10, "u", long + "!"), (11, "u", "x" * 99),
            (12, "u", "x" * 99), (13, "u", "x" * 100), (14, "u", "x" * 100), (None, "u", "nobody " * 20), (None, "u", "nobody " * 20),
            (15, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (16, "ü?", "\r\n\r\n")]
    found, folder = _written(spark, rows, tmp_path)
    first = {}
    for key, _, html in rows:
        if html and len(html.encode()) >= 100 and key is not None:
            first[html] = min(first.get(html, key), key)
    expected = []
    for key, _, html in rows:
        body = (html or "").encode()
        to = first.get(html)
        to = None if to is None or to == key else str(to)
        expected.append((None if key is None else str(key), len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to))
    by_text = lambda r: tuple(map(str, r))
    got = found.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=by_text) == sorted(expected, key=by_text)
    assert warc.gaps(found).count() == 0
    back = sorted(((r["key"], bytes(r["payload"]).decode()) for r in warc.restored(found).collect()), key=by_text)
    assert back == sorted(((None if k is None else str(k), h or "") for k, _, h in rows), key=by_text)
    plain = b"".join(gzip.decompress(bytes(r[0])) for r in spark.read.format("binaryFile").load(folder).select("content").collect())
    assert plain.count(b"WARC-Record-ID: ") == len(rows) and b"\r\nX: 1" not in plain


def test_empty_table(spark, tmp_path):
    found, _ = _written(spark, [], tmp_path)
    assert found.count() == 0


def _records(n, seed=0):
    made = random.Random(seed)
    bodies = [bytes(made.randrange(256) for _ in range(made.randrange(400))) for _ in range(n)]
    return [warc.record_of(str(i), f"http://h/{i}", b, hashlib.sha256(b).hexdigest()) for i, b in enumerate(bodies)]


def _held(rows, data):
    """The keys found, once the ranges are seen to cover the whole file in order."""
    at = 0
    for row in rows:
        if row.get("inner_offset") is None:
            assert row["offset"] == at
            at += row["length"]
    return [row["key"] for row in rows if "gap" not in row]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_only_what_it_touches(packed):
    parts = [warc.compressed(r) if packed else r for r in _records(12)]
    ends = [sum(map(len, parts[:k + 1])) for k in range(12)]
    whole = b"".join(parts)
    if not packed:
        assert _held(list(warc.salvage(whole)), whole) == [str(k) for k in range(12)]
    for seed in range(60):
        made = random.Random(seed)
        at = made.randrange(len(whole))
        hit = next(k for k in range(12) if at < ends[k])
        damaged = bytearray(whole)
        damaged[at] ^= 1 << made.randrange(8)
        found = [r["key"] for r in warc.salvage(bytes(damaged)) if "gap" not in r]
        others = [str(k) for k in range(12) if k != hit]
        assert [k for k in found if k in others] == others
    cut = list(warc.salvage(whole[:ends[5] + 7]))
    assert [r["key"] for r in cut if "gap" not in r] == [str(k) for k in range(6)]
    assert cut[-1]["gap"] and (cut[-1]["offset"], cut[-1]["length"]) == (ends[5], 7)
    junk = b"junk WARC/1.0\r\nnot a header\r\n\r\n \x1f\x8b\x08 more"
    found = list(warc.salvage(whole[:ends[3]] + junk + whole[ends[3]:]))
    assert [r["key"] for r in found if "gap" not in r] == [str(k) for k in range(12)]
    assert [(r["offset"], r["length"]) for r in found if "gap" in r] == [(ends[3], len(junk))]


def test_members_of_many_records_and_mixed_files():
    parts = _records(6, 1)
    bad = bytearray(parts[2])
    bad[-6] ^= 1
    one = warc.compressed(parts[0] + parts[1] + bytes(bad) + parts[3])
    data = one + warc.EMPTY_MEMBER + parts[4] + warc.compressed(parts[5])
    rows = list(warc.salvage(data))
    assert [r["key"] for r in rows if "gap" not in r] == ["0", "1", "3", "4", "5"]
    gap = next(r for r in rows if "gap" in r)
    assert gap["offset"] == 0 and gap["inner_offset"] == len(parts[0] + parts[1]) and gap["inner_length"] == len(bad)
    sha1 = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    right, wrong = sha1 % b"VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5", sha1 % b"AAAT4NSHA2AWVOR6EVYXQUGCNSONBWE5"
    assert [r.get("gap") for r in warc.salvage(right + wrong + right)] == [None, "block digest differs", None]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 3))
def test_any_bytes_are_read_to_the_end(junk, at):
    parts = [warc.compressed(r) for r in _records(3, 2)]
    data = b"".join(parts[:at]) + junk + b"".join(parts[at:])
    keys = [r["key"] for r in warc.salvage(data) if "gap" not in r]
    assert [k for k in keys if k in ("0", "1", "2")][:at] == [str(k) for k in range(at)]
    assert set(keys) >= {str(k) for k in range(3)} or junk  # junk may open a member that runs into the next one


def test_gaps_are_logged_by_file(spark, tmp_path):
    parts = [warc.compressed(r) for r in _records(5)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(parts[0] + b"??" + parts[1])
    (tmp_path / "y.warc").write_bytes(b"".join(_records(5)[2:]) + b"\r\n")
    found = warc.read_archives(spark, f"file://{tmp_path}")
    assert sorted(r["key"] for r in found.filter("gap is null").collect()) == list("01234")
    log = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in warc.gaps(found).collect()}
    assert log["x.warc.gz"] == (len(parts[0]), 2, None, None, "no version line")
    assert log["y.warc"][1:] == (2, None, None, "no version line")
