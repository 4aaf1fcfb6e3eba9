"""WARC archives with a two-level capture index.

Tasks write archives of gzip members, one record each, straight to the shared
file system. A task's files have names of their own, and only the captures
that Spark commits name them: what a lost or repeated attempt wrote is never
referred to. Captures are in order of their key: the URL with its host
reversed, and the page id. The index has those keys in compressed blocks, and
a sparse directory with the first key of each block. A lookup finds the part
of the index by its first key, the block by binary search in the part's
directory, the capture by binary search in the block; the record is then one
range of bytes, for which the archive is opened and only that range is read.

Archives are reached through ``pyarrow.fs`` from the URI of the shared folder
(``file``, ``hdfs``, ``s3``, ``gs``, ``abfs``).
"""

from __future__ import annotations

import bisect
import json
import math
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scratch_path, settle, ship

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
#: Archive size aimed at, and captures per index block and index part.
ARCHIVE_BYTES = 16 << 20
BLOCK_CAPTURES = 512
PART_CAPTURES = 50_000
#: Bytes of records that a task hands on at once.
BATCH_BYTES = 8 << 20
LEVEL = 5
WARC_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, path string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"


def surt(url: Column) -> Column:
    """Reversed-host key: ``http://a.B.org:80/x?y`` gives ``org,b,a:80)/x?y``.
    Null or hostless URLs give ``)`` and the rest."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    port = F.regexp_extract(authority, r":[0-9]+$", 0)
    path = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), path)


def _header_safe(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")


def capture_key(url: Column, page_id: Column) -> Column:
    """Sorts by reversed host and path, then page id; unique per page. Line
    ends count as blanks."""
    return _header_safe(F.concat(surt(url), F.lit(" "), F.lpad(F.coalesce(page_id.cast("string"), F.lit("")), 20, "0")))


def decide(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. One row per page with payload (binary),
    payload_bytes, payload_digest, refers_to (null: a response).

    Of equal payloads of at least REVISIT_BYTES the largest page_id is the
    response. A null html is an empty payload. Rows with a null page_id are
    responses; rows that repeat the largest page_id are all responses. Which
    payloads occur more than once is settled on digests alone; payloads move
    once at most, and short ones never.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    may = (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    twins = p.where(may).groupBy(F.unhex("payload_digest").alias("d")).agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    twins = settle(twins.select("d", "top"), "warc-twins")
    own = F.when(F.col("page_id") < F.col("top"), F.col("top"))
    long = p.where(may).join(twins, F.unhex("payload_digest") == F.col("d"), "left").select(*p.columns, own.alias("refers_to"))
    return long.unionByName(p.where(~may).withColumn("refers_to", F.lit(None).cast("long")))


def record_bytes(key: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {WARC_DATE}", "WARC-Target-URI: " + " ".join((url or "").replace("\r", "\n").split("\n")), f"X-Capture-Key: {key}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes gzip WARC files of about archive_bytes under path; returns their
    captures (CAPTURE)."""
    rows = decide(pages).withColumn("key", capture_key(F.col("url"), F.col("page_id")))

    def run(batches):
        files, folder = _open(path)
        out, name, at, rows = None, None, 0, []
        for batch in batches:
            cols = [batch.column(c) for c in ("key", "page_id", "url", "payload", "payload_digest", "refers_to")]
            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in cols]
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    files.create_dir(folder, recursive=True)
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                gz = zlib.compressobj(LEVEL, wbits=31)
                data = gz.compress(record_bytes(*values)) + gz.flush()
                out.write(data)
                rows.append((values[0], f"{path}/{name}", at, len(data)))
                at += len(data)
            yield _batch(rows)
            rows = []
        if out is not None:
            out.close()

    return settle(map_arrow(rows, run, CAPTURE), "warc-captures")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.string(), "path": pa.string(), "offset": pa.int64(), "length": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def _fields(record: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Header fields and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    found = dict(x.split(b": ", 1) if b": " in x else (x.rstrip(b":"), b"") for x in lines[1:])
    return found, rest[: int(found[b"Content-Length"])]


def members(stream, size: int = 1 << 20):
    """(offset, length, record) of each gzip member of a stream of bytes."""
    at, start, held = 0, 0, b""
    gz, parts = zlib.decompressobj(wbits=31), []
    while True:
        data = held or stream.read(size)
        held = b""
        if not data:
            break
        parts.append(gz.decompress(data))
        at += len(data)
        if gz.eof:
            at -= len(gz.unused_data)
            yield start, at - start, b"".join(parts)
            start, held, parts, gz = at, gz.unused_data, [], zlib.decompressobj(wbits=31)


def scan_archives(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """CAPTURE rows of whole archives that came without any: paths has their
    URIs in column path. Each archive is streamed by one task."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = _open(path)
                with files.open_input_stream(name, compression=None) as stream:
                    yield _batch([(_fields(r)[0][b"X-Capture-Key"].decode(), path, at, n) for at, n, r in members(stream)])

    return settle(map_arrow(paths.select("path"), run, CAPTURE), "warc-captures")


def build_index(captures: DataFrame, path: str) -> DataFrame:
    """Writes the index of captures and returns it: part, block, first_key,
    last_key, captures, data (compressed lines of key, file, offset, length)."""
    ship(captures.sparkSession)
    parts = max(1, math.ceil(captures.count() / PART_CAPTURES))
    ordered = captures.repartitionByRange(parts, "key", "path", "offset").sortWithinPartitions("key", "path", "offset")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def blocks(batches):
        held, number, part = [], 0, None

        def flush():
            data = zlib.compress("\n".join(json.dumps(r) for r in held).encode())
            return pd.DataFrame({"part": [part], "block": [number], "first_key": [held[0][0]], "last_key": [held[-1][0]], "captures": [len(held)], "data": [data]})

        for pdf in batches:
            for key, p, offset, length, part in pdf.itertuples(index=False):
                held.append((key, p, offset, length))
                if len(held) == BLOCK_CAPTURES:
                    yield flush()
                    held, number = [], number + 1
        if held:
            yield flush()

    ordered.mapInPandas(blocks, "part int, block int, first_key string, last_key string, captures int, data binary").write.parquet(path)
    return captures.sparkSession.read.parquet(path)


def find_in_part(keys: list[str], directory: pd.DataFrame) -> list[tuple]:
    """(key, path, offset, length) of the captures of keys; directory: the
    blocks of one part. Only blocks that may hold a key are decompressed."""
    directory = directory.sort_values("block")
    firsts, data, open_blocks, out = directory["first_key"].to_list(), directory["data"].to_list(), {}, []
    for key in keys:
        b = max(0, bisect.bisect_left(firsts, key) - 1)
        while b < len(firsts) and firsts[b] <= key:
            if b not in open_blocks:
                rows = [json.loads(x) for x in zlib.decompress(data[b]).decode().split("\n")]
                open_blocks[b] = ([r[0] for r in rows], rows)
            names, rows = open_blocks[b]
            at = bisect.bisect_left(names, key)
            while at < len(names) and names[at] == key:
                out.append(tuple(rows[at]))
                at += 1
            b += 1
    return out


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """key, path, offset, length of every capture of the keys (column key);
    null keys find nothing, repeated ones count once.

    The first level has one row per index part; parts are about PART_CAPTURES
    long. Where more keys than that fall into a part, they are dealt into
    several groups, each with the part's blocks.
    """
    top = index.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
    k = keys.select("key").where("key is not null").distinct()
    low = [(r["low"], r["high"], r["part"]) for r in top.orderBy("low").collect()]
    spots = [r[0] for r in low]

    def place(batches):
        for pdf in batches:
            out = []
            for key in pdf["key"]:
                i = max(0, bisect.bisect_left(spots, key) - 1)
                while i < len(low) and low[i][0] <= key:
                    if key <= low[i][1]:
                        out.append((key, low[i][2]))
                    i += 1
            yield pd.DataFrame(out, columns=["key", "part"])

    ship(keys.sparkSession)
    placed = settle(k.mapInPandas(place, "key string, part int"), "warc-placed")
    asked = placed.groupBy("part").agg(F.ceil(F.count("*") / F.lit(2 * PART_CAPTURES)).alias("groups"))
    spread = placed.join(asked, "part").withColumn("sub", F.pmod(F.xxhash64("key"), F.col("groups"))).select("key", "part", "sub")
    blocks = index.join(asked, "part").withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = find_in_part(sorted(a["key"]), b) if len(b) else []
        return pd.DataFrame(rows, columns=["key", "path", "offset", "length"])

    held = blocks.select("part", "sub", "block", "first_key", "data")
    return spread.groupBy("part", "sub").cogroup(held.groupBy("part", "sub")).applyInPandas(find, CAPTURE)


def runs(ranges: list[tuple[int, int]]) -> list[list]:
    """[offset, length, ranges] of reads: ranges that follow one another
    without a gap are one read of at most BATCH_BYTES, unless one is longer."""
    out: list[list] = []
    for at, n in sorted(ranges):
        if out and out[-1][0] + out[-1][1] == at and out[-1][1] + n <= BATCH_BYTES:
            out[-1][1] += n
            out[-1][2].append((at, n))
        else:
            out.append([at, n, [(at, n)]])
    return out


def _parsed(record: bytes) -> tuple:
    head, block = _fields(record)

    def number(name: bytes) -> int | None:
        value = head.get(name, b"")[len(b"<urn:page:") : -1]
        return int(value) if value else None

    kind = head[b"WARC-Type"].decode()
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    return number(b"WARC-Record-ID"), head[b"WARC-Target-URI"].decode(), kind, number(b"WARC-Refers-To"), digest, payload


def read_records(found: DataFrame) -> DataFrame:
    """Range reads: page_id, url, record_type, refers_to, payload_digest, and
    payload (null for revisits) of the captures that lookup() gives. A task has
    the ranges of an archive, so at most as many as it has records."""
    ranges = found.groupBy("path").agg(F.collect_set(F.struct("offset", "length")).alias("ranges"))
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]

    def run(batches):
        for batch in batches:
            for path, wanted in zip(batch.column("path").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                files, name = _open(path)
                with files.open_input_file(name) as archive:
                    rows, held = [], 0
                    for start, size, own in runs([(r["offset"], r["length"]) for r in wanted]):
                        archive.seek(start)
                        data = memoryview(archive.read(size))
                        for at, n in own:
                            rows.append(_parsed(zlib.decompress(data[at - start : at - start + n], wbits=31)))
                            held += n + len(rows[-1][5] or b"")
                            if held >= BATCH_BYTES:
                                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
                                rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return map_arrow(ranges, run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest (both of the
    full payload, a revisit's from its response), record_type, refers_to."""
    r = records.select(
        "page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("d")
    )
    r = settle(r, "warc-read")
    full = r.where("refers_to is null and page_id is not null").groupBy(F.col("page_id").alias("of")).agg(F.max("n").alias("n2"), F.max_by("d", "n").alias("d2"))
    direct = r.where("refers_to is null").select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    again = r.where("refers_to is not null").join(full, F.col("refers_to") == F.col("of")).select(
        "page_id", F.col("n2").alias("payload_bytes"), F.col("d2").alias("payload_digest"), "record_type", "refers_to"
    )
    return direct.unionByName(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives every page, indexes the archives, looks every page up and reads
    it back; the result of resolved(). Repeated rows are captures of their own;
    an empty table gives no rows."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    captures = write_archives(pages, scratch_path(spark, "warc"))
    cdx = build_index(captures, scratch_path(spark, "cdx"))
    keys = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    return resolved(read_records(lookup(keys, cdx)))
