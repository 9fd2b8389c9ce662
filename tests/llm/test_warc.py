"""WARC archives against plain Python's gzip, hashlib and base64."""

import base64
import glob
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from retenta.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first int, copy int"
END = b"\r\n\r\n"


def pages():
    rng = random.Random(3)
    bits = ["\r\n\r\n", "\r\n", "\r", "\n", "é", "漢", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "x" * 50, " ", "", "\r\r\n\r\n", "\r\n\r"]
    rows = [(i, f"http://a.example/{i}", "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(150)]
    rows += [(1000 + i, None if i % 3 else "http://b.example/\r\nX: y", "same <p>") for i in range(40)] + [(2000, "u", None), (2001, "u", "")]
    rows += [(None, "u", "of none"), (None, "u", "of none"), (None, "v", "same <p>"), (5, "u", "twice"), (5, "u", "twice"), (5, "v", "twice")]
    rows += [(3000, "long", "ab\r\n" * 900_000 + "\r\n\r\n"), (3001, "long", "z" * 70_000 + "\r\n" + "z" * 70_000 + "\r\n\r\n\r\n")]
    return rows


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1, 2) for r in rows], SCHEMA).repartition(4)


def expected(rows, min_bytes=0):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = []
    for html, ids in groups.items():
        size, first = len(html.encode()), max((i for i in ids if i is not None), default=None)
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        for place, page in enumerate(ids):
            revisit = place > 0 and size >= min_bytes
            out.append((page, size, sha(html), "revisit" if revisit else "response", first if revisit else None, True))
    return Counter(out)


@pytest.mark.parametrize("min_bytes, few", [(0, 10_000), (5, 10_000), (0, 0), (5, 0)])
def test_round_trip(spark, monkeypatch, min_bytes, few):
    monkeypatch.setattr(warc, "FEW_SHARED", few)
    rows = pages()
    records = warc.round_trip(frame(spark, rows), min_bytes=min_bytes).cache()
    assert Counter(tuple(r) for r in warc.digests(records).collect()) == expected(rows, min_bytes)
    texts = Counter((r["page_id"], bytes(r["payload"]).decode()) for r in records.filter("record_type = 'response'").collect())
    assert all((page, html) in {(p, h or "") for p, _, h in rows} for page, html in texts)
    urls = {r["url"] for r in records.filter("page_id >= 1000 AND page_id < 2000").collect()}
    assert urls == {None, "http://b.example/%0D%0AX: y"}
    records.unpersist()


def test_files_are_monolithic_then_members(spark, tmp_path):
    rows = pages()
    warc.write_archives(frame(spark, rows), str(tmp_path / "mono"))
    files = glob.glob(str(tmp_path / "mono" / "*.gz"))
    whole = b""
    for f in files:
        raw, one = open(f, "rb").read(), zlib.decompressobj(31)
        whole += one.decompress(raw)
        assert one.eof and not one.unused_data  # one gzip member from end to end
    archives = warc.normalise(spark, str(tmp_path / "mono"), str(tmp_path / "out")).collect()
    assert sum(r["records"] for r in archives) == len(rows)
    index = warc.read_index(spark, str(tmp_path / "out")).collect()
    assert len(index) == len({r["record_id"] for r in index}) == len(rows)
    # every revisit names a response that is there
    kinds = {r["record_id"]: r["kind"] for r in index}
    named = [line.split(b": ")[1].strip().decode() for line in whole.split(b"\r\n") if line.startswith(b"WARC-Refers-To:")]
    assert len(named) == sum(k == "revisit" for k in kinds.values()) and all(kinds[x] == "response" for x in named)
    by_file, again = defaultdict(list), b""
    for r in index:
        by_file[r["archive"]].append(r)
    for name, entries in by_file.items():
        raw = open(tmp_path / "out" / name, "rb").read()
        at = 0
        for r in sorted(entries, key=lambda r: r["offset"]):
            assert r["offset"] == at
            one = zlib.decompressobj(31)
            record = one.decompress(raw[at : at + r["length"]])
            assert one.eof and not one.unused_data and record.startswith(b"WARC/1.1") and record.endswith(END)
            at += r["length"]
        assert at == len(raw)
        again += gzip.decompress(raw)
    # in whatever order the files come, the last record is followed by none
    records = lambda data: sorted(x.removesuffix(b"WARC/1.1\r\n") for x in data.split(b"WARC-Type"))
    assert records(again) == records(whole)
    assert not glob.glob(str(tmp_path / "out" / "*.tmp"))


def test_one_record_by_its_offset(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}</p>" * 20) for i in range(300)]
    warc.write_archives(frame(spark, rows), str(tmp_path / "mono"))
    warc.normalise(spark, str(tmp_path / "mono"), str(tmp_path / "out"))
    index = warc.read_index(spark, str(tmp_path / "out")).filter(F.col("record_id").startswith("<urn:page:v77."))
    found = warc.read_records(spark, str(tmp_path / "out"), index).collect()
    assert [(r["page_id"], bytes(r["payload"]).decode()) for r in found] == [("77", "<p>77</p>" * 20)]


def test_text_ids_with_any_letters(spark):
    rows = [("a.b v", "u", "x"), ("", "u", "x"), (None, "u", "x"), ("é>%+", "u", "y")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert got == {("a.b v", "response", None), ("", "revisit", "a.b v"), (None, "revisit", "a.b v"), ("é>%+", "response", None)}


def test_no_pages(spark):
    assert warc.digests(warc.round_trip(frame(spark, []))).count() == 0


def test_members_of_pieces_of_any_size():
    rng = random.Random(1)
    bodies = [rng.randbytes(rng.randint(0, 40)) for _ in range(50)] + [b"", END, b"\r\n" * 9]
    records = [b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s" % (len(x), x) for x in bodies]
    stream = b"".join(x + END for x in records)
    for step in (1, 3, 1000, len(stream)):
        members, out, found = warc.Members("x"), b"", []
        for at in range(0, len(stream), step):
            for packed, record in members.feed(stream[at : at + step]):
                out += packed
                if record is not None:
                    found.append(gzip.decompress(out))
                    out = b""
        members.close()
        assert found == [x + END for x in records]
    with pytest.raises(ValueError):
        cut = warc.Members("x")
        list(cut.feed(stream[:-60]))
        cut.close()
