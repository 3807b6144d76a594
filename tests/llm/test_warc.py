"""Archives written and read back, damaged, rolled, and written again by other partitions."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import warc

ROWS = "page_id long, url string, html string, shard int, digest string, kind int"


def pages():
    long = "x" * 100
    rows = [(i, f"http://a/{i}", f"<p>page {i}</p>" * (i % 9)) for i in range(40)]
    rows += [(50, "http://b/1", long), (49, "http://b/2", long), (51, None, long), (None, "http://b/3", long), (None, None, long)]
    rows += [(60, "http://c", "short"), (61, "http://c", "short"), (61, "http://c", "short"), (62, None, None), (63, "", "")]
    rows += [(70, "http://d", "é😀" * 40)] * 5 + [(70, "http://e", "é😀" * 40)]
    rows += [(80, "http://f\r\nWARC-Type: x y", "h\r\n\r\nContent-Length: 3\r\n" * 9), (81, "http://g", "z" * 300_000), (-5, "http://h", "\x00\x01")]
    return rows


def table(spark, rows, parts):
    return spark.createDataFrame([(*r, 7, "d", 8) for r in rows], ROWS).repartition(parts)


def expected(rows):
    """(page_id, bytes, digest, type, refers_to) by plain Python."""
    groups = {}
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page is None, page or 0, url is None, url or "", page))
    out = []
    for data, group in groups.items():
        for k, r in enumerate(sorted(group, key=lambda r: r[:4])):
            again = len(data) >= 100 and k > 0
            out.append((r[4], len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(group, key=lambda r: r[:4])[4] if again else None))
    return sorted(out, key=repr)


def names(root):
    return sorted(f for f in os.listdir(root) if f.endswith(".warc.gz"))


def test_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    made = warc.write_warc(table(spark, pages(), 5), root, roll_bytes=2_000, shard_bytes=4_000)
    got = warc.read_warc(spark, root).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == expected(pages())
    assert sum(r["records"] for r in made.collect()) == len(pages()) and made.where("seq > 0").count()
    assert len({r["record_id"] for r in got}) == len(pages())
    by_name = {r["record_id"]: r for r in got}
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["record_type"] == "revisit":  # what it names is the response with its payload
            first = by_name[r["refers_to_record"]]
            assert first["record_type"] == "response" and first["payload_digest"] == r["payload_digest"] and first["page_id"] == r["refers_to"]
        else:
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
    assert {r["url"] for r in got if r["page_id"] == 80} == {"http://f%0D%0AWARC-Type:%20x%20y"}
    # Records lie in the order of ids, from shard to shard; each file is gzip, member after member.
    ids = [int(line.split(": ")[1]) for n in names(tmp_path / "a") for line in gzip.open(tmp_path / "a" / n, "rt", newline="", errors="replace").read().split("\r\n") if line.startswith("X-Page-Id")]
    assert ids == sorted(ids) and len(names(tmp_path / "a")) > 5
    assert not os.path.exists(tmp_path / "a" / "_tmp")


def test_files_are_the_same_whatever_the_partitions(spark, tmp_path):
    for k, parts in enumerate((1, 7)):
        warc.write_warc(table(spark, pages(), parts), f"file://{tmp_path}/{k}", roll_bytes=2_000, shard_bytes=4_000)
    assert names(tmp_path / "0") == names(tmp_path / "1")
    assert all((tmp_path / "0" / n).read_bytes() == (tmp_path / "1" / n).read_bytes() for n in names(tmp_path / "0"))


def test_empty_and_existing(spark, tmp_path):
    root = f"file://{tmp_path}/e"
    assert warc.write_warc(table(spark, [], 1), root).count() == 0
    assert warc.read_warc(spark, root).count() == 0
    with pytest.raises(Exception, match="exists"):
        warc.write_warc(table(spark, pages(), 1), root)


def test_damage_is_found(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    warc.write_warc(table(spark, pages()[:5], 1), root)
    at = tmp_path / "d" / names(tmp_path / "d")[0]
    whole = at.read_bytes()
    for bad in (whole[:-10], whole + warc.member([("WARC-Type", "response"), ("WARC-Record-ID", "x")], b"", 6), gzip.compress(gzip.decompress(whole).replace(b"page 1", b"page 7"))):
        at.write_bytes(bad)
        with pytest.raises(Exception):
            warc.read_warc(spark, root).collect()
    at.write_bytes(whole)
    assert warc.read_warc(spark, root).count() == 5


def test_renaming_may_be_repeated(spark, tmp_path):
    """A task that renames its files and is lost then is run again."""
    root, files = f"file://{tmp_path}", f"{tmp_path}/_tmp/files"
    os.makedirs(files)
    for n in ("a", "b"):
        with open(f"{files}/t-{n}", "wb") as f:
            f.write(b"12")
    lines = warc._table([(0, k, n, f"_tmp/files/t-{n}", 1, 2, "") for k, n in enumerate("ab")], warc.MANIFEST)
    for _ in range(2):
        list(warc._rename(root)([lines]))
        assert sorted(x for x in os.listdir(tmp_path) if x != "_tmp") == ["a", "b"]
    os.remove(tmp_path / "a")
    with pytest.raises(OSError, match="gone"):
        list(warc._rename(root)([lines]))


def test_hot_payload_is_sent_once_by_a_task(spark):
    rows = [(1, 5, "u", "d", 1, b"p" * 1000, None, None)] * 900 + [(2, 5, "u", "d", 1, b"q", None, None)]
    sent = list(warc._sent([])([warc._table([r[:5] + r[5:] for r in rows], "id long, uh long, url string, digest string, kind int, payload binary, ref_id long, ref_key string")]))
    out = [r for b in sent for r in b.to_pylist()]
    assert sorted((r["id"], r["kind"], r["n"], len(r["payload"] or b"")) for r in out) == [(1, 1, 1, 1000), (1, 2, 899, 0), (2, 1, 1, 1)]


def test_columns_of_other_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "body " * 30), (2, "v", "body " * 30)], "`my id` int, address string, `a.b` string")
    warc.write_warc(rows, f"file://{tmp_path}/c", "my id", "address", "a.b")
    got = warc.read_warc(spark, f"file://{tmp_path}/c", payloads=False).orderBy("page_id")
    assert [tuple(r) for r in got.select("page_id", "record_type", "refers_to", F.col("payload").isNull()).collect()] == [(1, "response", None, True), (2, "revisit", 1, True)]
