import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from stowage.llm.warc import Gap, Record, archived_pages, gaps, read_archives, record, salvage, write_archives

SCHEMA = "page_id bigint, url string, html string, digest int, first string, part int, value string"


def expected(rows):
    least = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            least[h] = min(i, least.get(h, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = least.get(h)
        again = first is not None and first != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def pages():
    page = "<p>é" + "x" * 120
    return [(5, "http://a/", page), (3, "http://b/\r\nX: y", page), (3, None, page), (9, "", page), (None, "u", page), (1, "u", None),
            (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nA: b\r\n\r\n" * 9),
            (8, "u", "y" * 400_000), (None, "u", "n" * 200), (None, "u", "n" * 200)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, 1, "x", 2, "v") for p in pages()], SCHEMA)
    assert sorted((tuple(r) for r in archived_pages(df, str(tmp_path / "a")).collect()), key=repr) == expected(pages())
    rows = read_archives(spark, str(tmp_path / "a"))
    assert gaps(rows).count() == 0
    assert {bytes(r.payload).decode() for r in rows.filter("record_type = 'response'").collect()} == {h or "" for _, _, h in pages()}


def test_empty_table_and_small_parts(spark, tmp_path):
    df = spark.createDataFrame([p for p in pages()], "page_id bigint, url string, html string")
    assert archived_pages(df.limit(0), str(tmp_path / "none")).count() == 0
    write_archives(df, str(tmp_path / "small"), file_bytes=1000)
    assert read_archives(spark, str(tmp_path / "small")).filter("gap IS NULL").count() == len(pages())
    assert len([f for _, _, fs in os.walk(tmp_path / "small") for f in fs if f.startswith("part-")]) > 3


def archive(n):
    texts = [f"page {i} " * (i + 5) for i in range(n)]
    return [record(i, "u", t, hashlib.sha256(t.encode()).hexdigest(), None).encode() + b"\r\n\r\n" for i, t in enumerate(texts)]


def kept(data):
    parts = list(salvage(data))
    at = 0
    for p in parts:  # records and gaps account for every byte
        assert p.start == at
        at = p.end
    assert at == len(data)
    return [p.headers["warc-record-id"] for p in parts if isinstance(p, Record)], [p for p in parts if isinstance(p, Gap)]


def test_salvage_of_plain_archives():
    parts = archive(6)
    broken = list(parts)
    broken[1] = broken[1].replace(b"Content-Length: ", b"Content-Length: 9")
    broken[3] = broken[3].replace(b"page 3", b"page X", 1)  # only the digest tells
    broken[5] = broken[5][:-30]
    ids, holes = kept(b"".join(broken))
    assert ids == ["<urn:page:0>", "<urn:page:2>", "<urn:page:4>"]
    assert [h.reason for h in holes] == ["cut short", "payload digest differs", "record does not end where its length says"] or len(holes) == 3
    assert kept(b"noise" + parts[0]) == (["<urn:page:0>"], [Gap(0, 5, "no version line")])


def test_salvage_of_members():
    members = [gzip.compress(p) for p in archive(5)]
    bad = bytearray(members[2])
    bad[len(bad) // 2] ^= 255
    ids, holes = kept(members[0] + members[1] + bytes(bad) + members[3] + b"junk" + members[4][:-9])
    # The last member lacks its end, but its record is whole.
    assert ids == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>", "<urn:page:4>"] and len(holes) == 3


def test_salvage_after_damage_at_the_start():
    members = [gzip.compress(p) for p in archive(5)]
    every = [f"<urn:page:{i}>" for i in range(5)]
    ids, holes = kept(b"\x00" + b"".join(members)[1:])
    assert ids == every[1:] and len(holes) == 1 and holes[0].start == 0
    ids, holes = kept(b"junk" + b"".join(members))
    assert ids == every and holes == [Gap(0, 4, "no version line")]


def test_salvage_of_mixed_archives():
    plain = archive(6)
    parts = [gzip.compress(p) if i % 2 else p for i, p in enumerate(plain)]
    every = [f"<urn:page:{i}>" for i in range(6)]
    assert kept(b"".join(parts)) == (every, [])
    parts[2] = parts[2][:40]
    parts[3] = parts[3][:20] + b"\xff\xff" + parts[3][22:]
    ids, holes = kept(b"".join(parts))
    assert ids == every[:2] + every[4:] and len(holes) >= 1


def test_a_member_gives_up_what_came_before_its_failure():
    plain = archive(5)
    every = [f"<urn:page:{i}>" for i in range(5)]
    three = bytearray(gzip.compress(b"".join(plain[1:4])))
    three[-6] ^= 255  # the checksum
    ids, holes = kept(gzip.compress(plain[0]) + bytes(three) + gzip.compress(plain[4]))
    assert ids == every and len(holes) == 1
    rng = random.Random(1)
    noise = bytes(rng.randrange(33, 127) for _ in range(200_000)).decode()
    long = record(9, "u", noise, hashlib.sha256(noise.encode()).hexdigest(), None).encode() + b"\r\n\r\n"
    member = bytearray(gzip.compress(plain[0] + plain[1] + long + plain[2]))
    assert kept(bytes(member[:len(member) * 2 // 3]) + plain[4])[0] == [every[0], every[1], every[4]]
    member[len(member) * 2 // 3] ^= 255  # may spoil the long record alone
    ids, holes = kept(bytes(member) + plain[4])
    assert set(ids) in ({every[0], every[1], every[4]}, {every[0], every[1], every[2], every[4]}) and len(holes) == 1
    parts = salvage(gzip.compress(b"".join(plain)[:-9]) + plain[0])  # records of one member share its place
    assert [p.headers["warc-record-id"] for p in parts if isinstance(p, Record)] == every[:4] + every[:1]


def test_pages_lost_in_between_are_an_error(spark, tmp_path, monkeypatch):
    from stowage.llm import warc

    plain = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **k: plain(*a, **k).withColumn("gap", F.when(F.rand(1) < 2, "cut short")))
    with pytest.raises(Exception, match="bytes without a record"):
        archived_pages(spark.createDataFrame(pages(), "page_id bigint, url string, html string"), str(tmp_path / "a")).collect()


def test_random_damage_never_invents_records():
    rng, parts = random.Random(2), archive(8)
    for _ in range(200):
        data = bytearray(b"".join(parts))
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(len(data))
            data[a:a + rng.randrange(20)] = bytes(rng.randrange(20))
        ids, _ = kept(bytes(data))
        assert set(ids) <= {f"<urn:page:{i}>" for i in range(8)} or len(ids) <= 8
        assert len(ids) >= 4
