"""WARC archives: a deterministic sharded writer, and a reader that checks every digest.

Records are ordered by (id, hash of the URL, URL, digest) and cut into shards by bounds that depend on the
rows alone: quantiles, by size, of a sample chosen by a hash of the keys. A shard is one task: it
makes headers and digests anew, compresses each record as a member of its own, and begins another file when the
compressed size passes a limit. Equal tables so give equal files, whatever the cluster, its partitions or its retries.

Which records revisit which is decided on keys alone; the decisions travel beside the payloads into the shards, sorted
ahead of the record that they are about, so that payloads are shuffled once and a task holds one record at a time.

Files are written under names of the attempt that makes them. Only attempts whose task succeeded are in
the list of files; those are renamed, and the manifest, written last, is what makes the archive exist. Renaming
can be repeated, so a lost executor costs its tasks.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, column, discard, lean, tidy

#: Payloads of fewer bytes are stored again instead of revisited.
LEAST_REVISIT = 100
#: Bytes of payload and headers in a shard; shards at most (beyond, they grow, and hold more files).
SHARD_BYTES, MOST_SHARDS = 16 << 20, 20_000
#: Compressed bytes after which a file ends; keys sampled for the bounds of shards, about.
ROLL_BYTES, SAMPLE = 256 << 20, 20_000
#: Keys that a task remembers so as to send the payload of repeated rows once.
SEEN = 50_000
HEADER_BYTES = 600

MANIFEST = "shard int, seq int, name string, made string, records long, bytes long, sha256 string"
_SENT = "id long, uh long, url string, digest string, kind int, n long, payload binary, ref_id long, ref_key string, shard int"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _where(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path there; a local URI may have one slash or three."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", root))


def record_id(page: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    """A record's name, made of what it holds: the same in every run."""
    said = "\n".join(("\0" if page is None else str(page), "\0" if url is None else url, digest, str(copy)))
    return f"<urn:sha256:{hashlib.sha256(said.encode()).hexdigest()}>"


def _header(value: str) -> str:
    """A header's value on one line: control characters and blanks as percent signs and hex, as in a URL."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]) + "\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join((pack.compress(head.encode()), pack.compress(block), pack.compress(b"\r\n\r\n"), pack.flush()))


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers: tuple[int | None, str] | None, date: str, level: int) -> bytes:
    """A response with its payload, or a revisit of ``refers`` (id, record name) without it."""
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page, url, digest, copy)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _header(url)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if refers:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Truncated", "length"), ("WARC-Refers-To", refers[1])]
        if refers[0] is not None:
            fields.append(("X-Refers-To-Page-Id", str(refers[0])))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(fields, http if refers else http + payload, level)


class _Files:
    """The files of one task attempt, rolled by compressed size."""

    def __init__(self, root: str, roll: int, date: str, level: int):
        self.fs, self.root = _where(root)
        self.roll, self.date, self.level, self.attempt = roll, date, level, uuid.uuid4().hex
        self.shard, self.seq, self.out, self.done = -1, 0, None, []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard or self.size >= self.roll:
            self.close()
            self.seq = self.seq + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha256()
            self.name = f"shard-{shard:05d}-{self.seq:05d}.warc.gz"
            self.made = f"_tmp/files/{self.attempt}-{self.name}"
            self.fs.create_dir(f"{self.root}/_tmp/files", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.root}/{self.made}", compression=None)
            body = f"software: quillmesh\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, "")), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], body, self.level))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.name, self.made, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])


def _sent(bounds: list[tuple]):
    """Rows with their shard. The payload of rows equal in all is sent once by a task, with a count of the others behind it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        again: dict[tuple, int] = {}

        def flush() -> list[tuple]:
            out = [(*key, 2, n, None, None, None, shard(key)) for key, n in again.items()]
            again.clear()
            seen.clear()
            return out

        def shard(key: tuple) -> int:
            return bisect.bisect_right(bounds, (key[0] is None, key[0] or 0, key[1]))

        for b in batches:
            rows = []
            at = dict(zip(b.schema.names, b.columns))
            for id_, uh, url, digest, kind, payload, ref_id, ref_key in zip(*(at[c].to_pylist() for c in ("id", "uh", "url", "digest", "kind", "payload", "ref_id", "ref_key"))):
                key = (id_, uh, url, digest)
                if kind == 1 and key in seen:
                    again[key] = again.get(key, 0) + 1
                    continue
                if kind == 1:
                    seen.add(key)
                rows.append((*key, kind, 1, payload, ref_id, ref_key, shard(key)))
            yield _table(rows, _SENT)
            if len(seen) > SEEN:
                yield _table(flush(), _SENT)
        yield _table(flush(), _SENT)
        tidy()

    return run


def _write(root: str, roll: int, date: str, level: int):
    """Files of a task's shards, from rows in order; gives their lines of the manifest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, copy, refers, payload = _Files(root, roll, date, level), None, 0, None, b""
        for b in batches:
            at = dict(zip(b.schema.names, b.columns))
            for i in range(b.num_rows):  # a payload at a time
                now = (at["shard"][i].as_py(), at["id"][i].as_py(), at["url"][i].as_py(), at["digest"][i].as_py())
                if now != key:
                    key, copy, refers = now, 0, None
                kind = at["kind"][i].as_py()
                if kind == 0:
                    refers = (at["ref_id"][i].as_py(), at["ref_key"][i].as_py())
                    continue
                payload = at["payload"][i].as_py() if kind == 1 else payload
                shard, page, url, digest = key
                for _ in range(at["n"][i].as_py()):
                    # The record that all others revisit is the first copy of its key.
                    mine = None if refers and copy == 0 and refers[1] == record_id(page, url, digest) else refers
                    files.add(shard, page_record(page, url, payload, digest, copy, mine, date, level))
                    copy += 1
        files.close()
        yield _table(files.done, MANIFEST)
        tidy()

    return run


def _rename(root: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _where(root)
        for b in batches:
            for name, made, size in zip(*(b.column(c).to_pylist() for c in ("name", "made", "bytes"))):
                if where.get_file_info(f"{base}/{made}").type == fs.FileType.NotFound:  # an earlier attempt was here
                    if where.get_file_info(f"{base}/{name}").size != size:
                        raise OSError(f"{name} is gone")
                else:
                    where.move(f"{base}/{made}", f"{base}/{name}")
            yield b

    return run


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", level: int = 6, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` to archives in the folder ``root`` (a URI that all executors reach), and return the manifest.

    Of rows with equal payloads of at least LEAST_REVISIT bytes that of the least (id, URL) is the response and
    all others revisit it; smaller ones are all responses. A null payload is empty. A null id comes after all others,
    and so does a null URL; such fields are left out of the record. Rows equal in id, URL and payload are records of
    their own, numbered. An empty table makes an archive of no file. Other columns are left out, so their names cannot
    clash. Payloads are of any length that a row can have. An archive that exists already is an error.
    """
    spark = pages.sparkSession
    lean(pages)
    payload = F.coalesce(column(pages, payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(column(pages, id_col).cast("long").alias("id"), column(pages, url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("id", F.xxhash64("url").alias("uh"), "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")
    keys = checkpointed(rows.groupBy("id", "uh", "url", "digest", "size").agg(F.count("*").alias("n")))

    # Decisions, on keys alone.
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url")
    large = keys.where(F.col("size") >= LEAST_REVISIT)
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.sum("n").alias("total")).where("total > 1")
    said = F.concat_ws("\n", F.coalesce(F.col("first.id").cast("string"), F.lit("\0")), F.coalesce("first.url", F.lit("\0")), "digest", F.lit("0"))  # as record_id has it
    first = first.select("digest", F.col("first.id").alias("ref_id"), F.concat(F.lit("<urn:sha256:"), F.sha2(said, 256), F.lit(">")).alias("ref_key"))
    told = large.join(first, "digest").select("id", "uh", "url", "digest", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("payload"), "ref_id", "ref_key")
    sent = rows.select("id", "uh", "url", "digest", F.lit(1).alias("kind"), "payload", F.lit(None).cast("long").alias("ref_id"), F.lit(None).cast("string").alias("ref_key")).unionByName(told)

    # Bounds of shards, by size, from a sample of keys that a hash chooses.
    weight = F.col("n") * (F.col("size") + HEADER_BYTES)
    totals = keys.agg(F.count("*").alias("keys"), F.sum(weight.cast("decimal(38,0)")).alias("bytes")).first()
    shards = min(max(1, math.ceil(int(totals["bytes"] or 0) / shard_bytes)), MOST_SHARDS)
    bounds: list[tuple] = []
    if shards > 1:
        one_in = max(1, totals["keys"] // SAMPLE)
        some = keys.where(F.pmod(F.xxhash64("id", "url", "digest"), F.lit(one_in)) == 0).select("id", "uh", weight.alias("w")).collect()
        some = sorted(((r["id"] is None, r["id"] or 0, r["uh"]), int(r["w"])) for r in some)
        each, sum_ = sum(w for _, w in some) / shards, 0
        for key, w in some:
            if sum_ >= each * (len(bounds) + 1):
                bounds.append(key)
            sum_ += w
    shards = len(bounds) + 1
    placed = sent.mapInArrow(_sent(bounds), _SENT).repartitionById(shards, F.col("shard"))
    placed = placed.sortWithinPartitions("shard", F.asc_nulls_last("id"), "uh", F.asc_nulls_last("url"), "digest", "kind")
    made = placed.mapInArrow(_write(root, roll_bytes, date, level), MANIFEST)
    made.write.parquet(f"{root}/_tmp/made")
    files = spark.read.schema(MANIFEST).parquet(f"{root}/_tmp/made")
    files.mapInArrow(_rename(root), MANIFEST).drop("made").write.json(f"{root}/manifest")
    discard(spark, f"{root}/_tmp")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The files of an archive; one without a manifest was never finished."""
    return spark.read.schema(MANIFEST).json(f"{root}/manifest").drop("made")


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each gzip member of a file, read a chunk at a time; a file that breaks off is an error."""
    rest, unpack, parts = b"", None, []
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            break
        unpack = unpack or zlib.decompressobj(31)
        parts.append(unpack.decompress(rest))
        rest = unpack.unused_data
        if unpack.eof:
            head, _, body = b"".join(parts).partition(b"\r\n\r\n")
            parts, unpack = [], None
            yield head, body
    if unpack is not None:
        raise OSError("the file ends within a record")


def parse(head: bytes, body: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and block; a digest or length that does not agree is an error."""
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block, tail = body[: int(fields["Content-Length"])], body[int(fields["Content-Length"]) :]
    if not lines[0].startswith("WARC/") or tail != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise OSError(f"record {fields.get('WARC-Record-ID')} is damaged")
    return fields, block


RECORD = "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload binary"


def _read(root: str, with_payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _where(root)
        for b in batches:
            for name, records, sha in zip(*(b.column(c).to_pylist() for c in ("name", "records", "sha256"))):
                rows, held, count, digest = [], 0, 0, hashlib.sha256()

                class Hashed:
                    def __init__(self, f):
                        self.f = f

                    def read(self, n: int) -> bytes:
                        data = self.f.read(n)
                        digest.update(data)
                        return data

                with where.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for head, body in members(Hashed(f)):
                        fields, block = parse(head, body)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        count += 1
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != said):
                            raise OSError(f"the payload of {fields['WARC-Record-ID']} is damaged")
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        rows.append((number("X-Page-Id"), fields.get("WARC-Target-URI"), fields["WARC-Record-ID"], kind, size, said, number("X-Refers-To-Page-Id"), fields.get("WARC-Refers-To"), payload if with_payload and kind == "response" else None))
                        held += len(payload) * with_payload
                        if len(rows) >= 1_000 or held >= 1 << 24:
                            yield _table(rows, RECORD)
                            rows, held = [], 0
                if count != records or digest.hexdigest() != sha:
                    raise OSError(f"{name} is not the file that was written")
                yield _table(rows, RECORD)
        tidy()

    return run


def read_warc(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records (RECORD) of an archive's files, read as streams, a file by one task, with all digests and lengths checked.

    Revisits have no payload; their length and digest are those of what they revisit. Without ``payloads`` responses have none either.
    """
    files = manifest(spark, root)
    n = files.count()
    return files.repartition(min(max(n, 1), MOST_SHARDS)).mapInArrow(_read(root, payloads), RECORD)
