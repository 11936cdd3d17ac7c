"""WARC archives: round trip, revisits, and salvage of damaged files."""

import gzip
import random

import oracle_check
import pytest
from vertexloom.llm import warc


def test_round_trip(spark, tmp_path):
    big = "x" * 150
    rows = [(5, "http://a/é \r\n", big), (3, "u", big), (3, "u", big), (9, None, big), (None, "n", big), (1, "s", "short"), (2, "s", "short"), (4, "e", None), (6, "e", ""), (7, "l", "ü" * 20_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    warc.write_pages(pages, f"{tmp_path}/w", records_per_file=3)
    got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert not [r for r in got if r["kind"] == "gap"]
    kinds = sorted((r["record_id"], r["kind"], r["refers_to"]) for r in got)
    assert kinds.count(("<urn:page:3>", "response", None)) == 2
    assert ("<urn:page:5>", "revisit", "<urn:page:3>") in kinds and ("<urn:page:9>", "revisit", "<urn:page:3>") in kinds
    assert ("<urn:page:>", "response", None) in kinds and len(kinds) == len(rows)
    texts = {r["record_id"]: bytes(r["payload"]).decode() for r in got if r["kind"] == "response"}
    assert texts["<urn:page:7>"] == "ü" * 20_000_000 and texts["<urn:page:4>"] == "" and texts["<urn:page:1>"] == "short"
    for f in (tmp_path / "w").rglob("part-*"):
        gzip.decompress(f.read_bytes())
    assert len(list((tmp_path / "w").glob("step-*"))) == 2  # the long page stands apart


def test_empty(spark, tmp_path):
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == 0


def parts(data):
    out = list(warc.salvage(data))
    return [r.headers["warc-record-id"] for r in out if isinstance(r, warc.Record)], [(g.start, g.end) for g in out if isinstance(g, warc.Gap)]


def test_salvage():
    raw = [warc.page_record(i, f"u{i}", (f"page {i} " * 30).encode()) for i in range(6)]
    zipped = [warc.member(r) for r in raw]
    ids = [f"<urn:page:{i}>" for i in range(6)]
    assert parts(b"".join(zipped)) == (ids, [])
    assert parts(b"".join(raw)) == (ids, [])
    assert parts(raw[0] + zipped[1] + raw[2]) == (ids[:3], [])
    for form in (raw, zipped):
        bad = bytearray(b"".join(form))
        at = len(form[0]) + len(form[1]) // 2
        bad[at] ^= 0xFF  # inside record 1
        found, gaps = parts(bytes(bad))
        assert found == [ids[0], *ids[2:]] and gaps == [(len(form[0]), len(form[0]) + len(form[1]))]
        cut = b"".join(form)[: -len(form[5]) // 2]
        found, gaps = parts(cut)
        assert found == ids[:5] and gaps == [(sum(map(len, form[:5])), len(cut))]
        junk = b"junk" + form[0] + b"\x1f\x8b\x08 WARC/1.1\r\n" + form[1]
        found, gaps = parts(junk)
        assert found == ids[:2] and gaps[0] == (0, 4) and len(gaps) == 2
    assert parts(b"") == ([], [])
    nested = warc.page_record(8, "u", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + b"z" * 200)
    assert parts(nested) == (["<urn:page:8>"], [])


def test_salvage_inside_members():
    raw = [warc.page_record(i, f"u{i}", random.Random(i).randbytes(400)) for i in range(4)]
    ids = [f"<urn:page:{i}>" for i in range(4)]
    bad = bytearray(b"".join(raw[:3]))
    bad[len(raw[0]) + len(raw[1]) // 2] ^= 0xFF  # the second of three records, packed as it is
    data = warc.member(bytes(bad)) + warc.member(raw[3])
    out = list(warc.salvage(data))
    assert parts(data)[0] == [ids[0], ids[2], ids[3]]
    gap = [g for g in out if isinstance(g, warc.Gap)]
    size = len(warc.member(bytes(bad)))
    assert [(g.start, g.end, g.inner, g.reason) for g in gap] == [(0, size, (len(raw[0]), len(raw[0]) + len(raw[1])), "block digest differs")]
    whole = b"".join(raw)
    for cut in (12, 4, 1):  # the end of the only member is missing
        data = gzip.compress(whole)[:-cut]
        assert parts(data)[0] == (ids if cut < 12 else ids[: len(parts(data)[0])]) and len(parts(data)[0]) >= 3
        assert [(g.start, g.end, g.reason) for g in warc.salvage(data) if isinstance(g, warc.Gap)] == [(0, len(data), "gzip member cut short")]
    hurt = bytearray(gzip.compress(whole))
    hurt[-6] ^= 1  # the checksum alone
    data = bytes(hurt) + warc.member(raw[3])
    assert parts(data)[0] == [*ids, ids[3]]
    assert [g.reason for g in warc.salvage(data) if isinstance(g, warc.Gap)] == ["gzip: checksum or length differs"]
    named = b"\x1f\x8b\x08\x08\0\0\0\0\0\xffname.warc\0" + gzip.compress(whole, mtime=0)[10:]
    assert parts(named) == (ids, [])


def test_random_damage_never_raises():
    rnd = random.Random(5)
    data = b"".join(warc.member(warc.page_record(i, "u", rnd.randbytes(300))) for i in range(5))
    for _ in range(200):
        bad = bytearray(data)
        for _ in range(rnd.randrange(1, 4)):
            bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        out = list(warc.salvage(bytes(bad)))
        assert sum(isinstance(r, warc.Record) for r in out) >= 2


@pytest.mark.parametrize("name", ["op4_warc", "op2_chat", "op5_mixing"])
def test_against_sql(spark, sf_dir, name):
    said, ok = oracle_check.compare(spark, sf_dir, name, oracle_check.connect(sf_dir))
    assert ok, said
