"""Legacy archive converter: ARC records become WARC records.

An ARC archive begins with a version block (a ``filedesc://`` record whose body
names the version and, for version 2, the longer header line); every record is
one header line, a body of the declared length, and a line feed. The
converter reads the version, splits each header line by its version's fields,
takes exactly the declared number of bytes, and makes up what WARC wants:
record id (a UUID of version 5 over archive, address, date and ordinal, so a
retry gives the same), date, type, content type, and SHA-1 digests in base 32 of
payload and block. The version block becomes a ``warcinfo`` record. A body that
begins with an HTTP status line is a ``response`` of type ``application/http``,
whose payload is what follows its header; any other body is a ``resource``.

Of records with equal payloads one is the response and the others revisit it,
with a revisit record that has no payload but names the response, the digest
and the payload's length. The choice needs one aggregation by digest (partial
on the map side) and one join of exchanged tables, which adaptive execution
splits where a payload holds many rows; payloads travel once.

Archives are written by Spark as plain text whose line separator is the record
separator of WARC, so any file system that Spark writes will do, and read back
by ``binaryFile``, which takes a file whole: a file holds at most ``PER_FILE``
records of up to ``LARGE_BYTES``, a gigabyte of payloads in all, and a record
above that has a file of its own. Reading resolves ``WARC-Refers-To`` by a join on the ids of the responses read.

Defined results: a null payload is empty; a null address is written as ``-``;
records cut off by the end of an archive, or with malformed header lines, are
reported with an error and no payload, as are damaged records of WARC archives
when they are read, after which reading goes on at the next record; HTTP headers
may end with bare line feeds; an archive without version block counts as
version 1; repeated rows are records of their own, of which those that tie as
the largest are responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillion.llm.common import arrow_map, small_batches
from quillion.session import cut, read, shared_path

PER_FILE, LARGE_BYTES, ARC_BYTES = 1000, 1 << 20, 4 << 20
#: The header lines of ARC 1 and ARC 2.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def resync(raw: bytes, at: int, version: int) -> tuple[int, int] | None:
    """Place and version of the first whole record from the line at ``at`` on; None if there is none.

    Its header has the fields of a version (the given one is tried first), an
    address with a colon, a date of 14 digits, and a length that ends before a
    line feed or with the archive.
    """
    while 0 <= at < len(raw) and (end := raw.find(b"\n", at)) >= 0:
        line = raw[at:end].rstrip(b"\r").decode("utf-8", "replace")
        for v in (version, 3 - version):
            got, names = line.split(" "), FIELDS[v]
            rec = dict(zip(names[1:], got[len(got) - len(names) + 1 :], strict=True)) if len(got) >= len(names) else {}
            if rec and ":" in got[0] and rec["date"].isascii() and rec["date"].isdigit() and len(rec["date"]) == 14 and rec["length"].isascii() and rec["length"].isdigit():
                stop = end + 1 + int(rec["length"])
                if stop == len(raw) or raw[stop : stop + 1] == b"\n":
                    return at, v
        at = end + 1
    return None


def parse_arc(raw: bytes) -> Iterator[dict]:
    """Records of one ARC archive, without its version block.

    Each has ordinal, version, url, ip, date, type, payload and error (null if
    the record is whole). Past a broken record no length can be trusted, so
    parsing goes on at the next line that is the header of a whole record, and
    the error says how many bytes were skipped; it stops if there is none.
    """
    version, at, ordinal = 1, 0, 0
    while at < len(raw):
        end = raw.find(b"\n", at)
        line = raw[at : end if end >= 0 else len(raw)].rstrip(b"\r").decode("utf-8", "replace")
        if not line.strip() and end >= 0:
            at = end + 1
            continue
        head = line.startswith("filedesc://")
        names = FIELDS[1] if head else FIELDS[version]
        got = line.split(" ")
        # addresses may hold spaces: the last fields are counted from the end
        got = [" ".join(got[: len(got) - len(names) + 1]), *got[len(got) - len(names) + 1 :]] if len(got) > len(names) else got
        rec = dict(zip(names, got, strict=False))
        ok = len(got) == len(names) and rec["length"].isascii() and rec["length"].isdigit() and end >= 0
        size = int(rec["length"]) if ok else 0
        body = raw[end + 1 : end + 1 + size] if ok else b""
        error = None if ok and len(body) == size else "malformed header line" if not ok else "cut off"
        # after a broken record: where the next whole one begins
        after = resync(raw, end + 1, version) if error and end >= 0 else None
        if after:
            error = f"{error}; {after[0] - at} bytes skipped"
        if head and error is None:
            first = body.split(b"\n", 1)[0].split()
            version = int(first[0]) if first and first[0] in (b"1", b"2") else 1
        else:
            yield {"ordinal": ordinal, "version": version, "url": rec.get("url"), "ip": rec.get("ip"), "date": rec.get("date"), "type": rec.get("type"), "payload": None if error else body, "error": error}
            ordinal += 1
        if error and not after:
            return
        at, version = after or (end + 1 + size, version)


def warc_date(date: str | None) -> str:
    """ARC's yyyymmddhhmmss (or shorter) as WARC's timestamp."""
    d = date if date and date.isascii() and date.isdigit() and len(date) >= 4 else "19700101000000"
    d = d[:14] + "00000101000000"[len(d[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_split(body: bytes) -> tuple[bytes, bytes]:
    """(header with its empty line, payload); the header is empty if the body is no HTTP response."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    # the first empty line ends it; old crawlers wrote bare line feeds
    ends = [at + len(gap) for gap in (b"\r\n\r\n", b"\n\n") if (at := body.find(gap)) >= 0]
    return (body[: min(ends)], body[min(ends) :]) if ends else (b"", body)


CONVERTED = [
    T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("http", T.BinaryType()), T.StructField("ordinal", T.LongType()), T.StructField("arc_version", T.IntegerType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("ip", T.StringType()), T.StructField("date", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("block_digest", T.StringType()), T.StructField("error", T.StringType()),
]


def convert(arcs: DataFrame, key_col: str = "key", arc_col: str = "arc", keys_col: str | None = None) -> DataFrame:
    """WARC fields of every record of every ARC archive (binary ``arc_col``, named by ``key_col``).

    kind is warcinfo (one for each archive), response or resource. The key of a
    record is its archive's, or where ``keys_col`` has a list of keys, the one at
    the record's place.
    """
    small_batches(arcs.sparkSession)
    schema = to_arrow_schema(T.StructType(CONVERTED))

    def made(key: str, r: dict, kind: str, http: bytes, body: bytes, of: str) -> dict:
        return {
            "key": key, "kind": kind, "http": http, "ordinal": r["ordinal"], "arc_version": r["version"], "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{of} {r["ordinal"]} {r["url"]} {r["date"]}')}",
            "target_uri": r["url"], "ip": r["ip"], "date": warc_date(r["date"]), "content_type": "application/http; msgtype=response" if http else r["type"], "payload": body,
            "payload_bytes": len(body), "payload_digest": base32_sha1(body), "block_digest": base32_sha1(http + body), "error": r["error"],
        }

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            held = 0
            for key, raw, keys in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                info = f"software: quillion\r\nformat: WARC File Format 1.0\r\nisPartOf: {key}\r\n".encode()
                if raw:
                    out.append(made(key, {"ordinal": -1, "version": None, "url": None, "ip": None, "date": None, "type": "application/warc-fields", "error": None}, "warcinfo", b"", info, key))
                for r in parse_arc(raw or b""):
                    http, body = http_split(r["payload"] or b"")
                    own = keys[r["ordinal"]] if keys is not None and r["ordinal"] < len(keys) else key
                    out.append(made(own, r, "response" if http else "resource", http, body, key))
                    held += len(body)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    keys = F.lit(None) if keys_col is None else F.col(keys_col)
    return arcs.select(F.col(key_col).cast("string").alias("key"), F.col(arc_col).cast("binary").alias("arc"), keys.cast("array<string>").alias("keys")).mapInArrow(rows, T.StructType(CONVERTED))


def with_revisits(records: DataFrame, least_bytes: int = 0, order: str = "key") -> DataFrame:
    """Adds record_type and the key and id that revisits refer to.

    Of records with one digest and at least ``least_bytes`` bytes, the one with
    the largest ``order`` (a column or SQL expression) is the response; rows that
    tie with it in that order are responses as well.
    """
    of = F.expr(order)
    own = F.col("error").isNull() & (F.col("kind") != "warcinfo") & (F.col("payload_bytes") >= least_bytes)
    some = records.where(own)
    heads = some.groupBy("payload_digest").agg(F.max(F.struct(of.alias("o"), "key", "record_id")).alias("h"), F.count("*").alias("n")).where("n > 1")
    heads, _ = cut(heads.select("payload_digest", "h"), "warc-heads")
    df = records.join(heads, "payload_digest", "left")
    again = own & F.col("h").isNotNull() & (of < F.col("h.o"))
    return df.select(
        *records.columns,
        F.when(again, "revisit").otherwise(F.col("kind")).alias("record_type"),
        F.when(again, F.col("h.record_id")).alias("refers_id"),
    )


def written(records: DataFrame, path: str, per_file: int = PER_FILE, large: int = LARGE_BYTES, largest: int | None = None) -> None:
    """Write WARC/1.0 archives to ``path``: one record per row, without errors.

    A file holds ``per_file`` records of at most ``large`` bytes, or one larger
    record, so that no file outgrows what one task can hold. ``largest`` (no
    record has more bytes) spares a look at the records for larger ones.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit("\r\n"))).otherwise("")
    revisit, info = F.col("record_type") == "revisit", F.col("record_type") == "warcinfo"
    # a revisit has the HTTP header alone
    body = F.concat(F.col("http"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.format_string("<%s>", "record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-IP-Address", F.when(F.col("ip") != "-", F.col("ip"))),
        line("WARC-Payload-Digest", F.when(~info, F.concat(F.lit("sha1:"), "payload_digest"))),
        line("WARC-Block-Digest", F.when(~revisit, F.concat(F.lit("sha1:"), "block_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, F.format_string("<%s>", "refers_id"))),
        line("WARC-Truncated", F.when(revisit, F.lit("length"))),
        line("X-Source-Key", F.col("key")),
        line("X-Payload-Length", F.when(~info, F.col("payload_bytes"))),
        line("Content-Type", F.col("content_type")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head.cast("binary"), body).cast("string")
    good = records.where(F.col("error").isNull())
    size = F.coalesce(F.octet_length("http") + F.octet_length("payload"), F.lit(0))
    if largest is None:
        largest = good.agg(F.max(size)).collect()[0][0] or 0
    parts = [(good, per_file)] if largest <= large else [(good.where(size <= large), per_file), (good.where(size > large), 1)]
    for rows, most in parts:
        rows.select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(path)


#: How a record begins.
_FIRST_LINE = re.compile(rb"WARC/1\.[0-9]\r\n[A-Za-z-]+:")


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of an archive.

    What can't be read gives one pair with the field ``error`` and no block;
    reading goes on where the next record's first lines are.
    """
    at = 0
    while at < len(raw):
        fields, block, after, error = _record(raw, at)
        if error is None:
            yield fields, block
            at = after
        else:
            yield {"error": error}, b""
            found = _FIRST_LINE.search(raw, at + 1)
            at = found.start() if found else len(raw)


def _record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int, str | None]:
    """(fields, block, where the next record begins, error) of the record at a byte."""
    end = raw.find(b"\r\n\r\n", at)
    lines = raw[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        return {}, b"", at, f"a record at byte {at} has no end of header" if end < 0 else f"no record begins at byte {at}"
    if _FIRST_LINE.search(raw, at + 1, end):
        return {}, b"", at, f"the record at byte {at} is cut off in its header"
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    said = fields.get("content-length", "")
    if not (said.isascii() and said.isdigit()):
        return {}, b"", at, f"the record at byte {at} has no length"
    start = end + 4
    stop = start + int(said)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        return {}, b"", at, f"the record at byte {at} is cut off"
    return fields, raw[start:stop], stop + 4, None


READ = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("content_type", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_id", T.StringType()), T.StructField("intact", T.BooleanType()), T.StructField("error", T.StringType()),
])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``, without those of type warcinfo; refers_key is the key of the response that a revisit names.

    intact: digests and length are those that the header names (revisits have
    no payload and only name its digest and length). What can't be read is a row
    with an error and nothing else, and costs no other record.
    """
    small_batches(spark)
    archives = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(READ)
        for b in batches:
            for raw in b.column(0):
                out = []
                for f, block in parse_warc(raw.as_py()):
                    if "error" in f:
                        out.append({"intact": False, "error": f["error"]})
                        continue
                    if f.get("warc-type") == "warcinfo":
                        continue
                    revisit = f.get("warc-type") == "revisit"
                    said, size = f.get("warc-payload-digest", "").removeprefix("sha1:"), int(n) if (n := f.get("x-payload-length", "")).isdigit() else -1
                    payload = http_split(block)[1] if f.get("content-type", "").startswith("application/http") else block
                    digest = said if revisit else base32_sha1(payload)
                    whole = not payload if revisit else digest == said and len(payload) == size and f.get("warc-block-digest") == "sha1:" + base32_sha1(block)
                    out.append({
                        "key": f.get("x-source-key"), "record_id": f.get("warc-record-id", "").strip("<>") or None, "record_type": f.get("warc-type"), "target_uri": f.get("warc-target-uri"), "date": f.get("warc-date"), "content_type": f.get("content-type"),
                        "payload_bytes": size if revisit else len(payload), "payload_digest": digest, "refers_id": f.get("warc-refers-to", "").strip("<>") or None if revisit else None, "intact": whole, "error": None,
                    })
                yield pa.RecordBatch.from_pylist(out, schema)

    # read once: what the records are without their payloads
    got, _ = cut(archives.mapInArrow(rows, READ), "warc-read")
    named = got.where(F.col("refers_id").isNotNull()).select(F.col("refers_id").alias("named")).distinct()
    heads = got.where(F.col("record_type") != "revisit").join(named, F.col("record_id") == F.col("named"), "left_semi").select(F.col("record_id").alias("refers_id"), F.col("key").alias("refers_key"))
    return got.join(heads, "refers_id", "left")


def arc_bytes(url, payload, date, version):
    """An ARC archive of one record (binary column), with its version block; for tests and the query."""
    block = F.when(version == 2, F.lit(version_block(2))).otherwise(F.lit(version_block(1)))
    return F.concat(block, record_head(url, payload, date, version).cast("binary"), payload, F.lit(b"\n"))


def version_block(version: int) -> bytes:
    """The version block of an ARC archive."""
    said = {1: "1 0 quillion\nURL IP-address Archive-date Content-type Archive-length\n", 2: "2 0 quillion\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"}[version]
    return f"filedesc://pages.arc 0.0.0.0 20240101000000 text/plain {len(said)}\n{said}\n".encode()


def record_head(url, body, date, version):
    """The header line of an ARC record (string column) of the given version."""
    size = F.octet_length(body).cast("string")
    clean = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("-")), "\\s+", "%20")
    clean = F.when(clean == "", "-").otherwise(clean)
    return F.concat(clean, F.lit(" 0.0.0.0 "), date, F.when(version == 2, " text/html 200 - - 0 pages.arc ").otherwise(" text/html "), size, F.lit("\n"))


def archives_of(records: DataFrame, key: str, most: int = ARC_BYTES) -> DataFrame:
    """ARC archives (key, keys, arc) of rows (key, version, head, body): each holds neighbouring rows of one version, about ``most`` bytes of them or a larger row."""
    small_batches(records.sparkSession)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("arc", T.BinaryType())])
    want = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            open_: dict[int, tuple[list, list, list]] = {}
            for k, v, head, body in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                keys, parts, size = open_.setdefault(v, ([], [version_block(v)], [0]))
                keys.append(k)
                parts.append(head.encode() + body + b"\n")
                size[0] += len(body)
                if size[0] >= most:
                    yield pa.RecordBatch.from_pylist([{"key": f"{v}-{keys[0]}", "keys": keys, "arc": b"".join(parts)}], want)
                    del open_[v]
            for v, (keys, parts, _) in open_.items():
                yield pa.RecordBatch.from_pylist([{"key": f"{v}-{keys[0]}", "keys": keys, "arc": b"".join(parts)}], want)

    return records.select(F.col(key).cast("string"), "version", "head", "body").mapInArrow(rows, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as ARC archives of both versions, with HTTP headers where the address is one of the web; converted, written as WARC and read back."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    version = F.when(F.pmod(F.xxhash64("page_id"), F.lit(2)) == 0, 1).otherwise(2)
    # a payload that looks like an HTTP response needs a header in front of it, so that it isn't taken for one
    web = F.coalesce(F.col("url").rlike("(?i)^https?://"), F.lit(False)) | (F.substring("payload", 1, 5) == F.lit(b"HTTP/"))
    http = F.when(web, F.lit(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n")).otherwise(F.lit(b""))
    body = F.concat(http, "payload")
    arcs = archives_of(pages.select("page_id", version.alias("version"), record_head(F.col("url"), body, F.lit("20240101000000"), version).alias("head"), body.alias("body")), "page_id")
    path = shared_path(spark, "warc")
    # no record is larger than the largest body or an archive's information
    largest = max(4096, pages.agg(F.max(F.octet_length("payload"))).collect()[0][0] or 0) + 4096
    written(with_revisits(convert(arcs, keys_col="keys"), 0, "cast(key as bigint)"), path, largest=largest)
    back = read_back(spark, path).where("error is null")
    kind = F.when(F.col("record_type") == "revisit", "revisit").otherwise("response")  # in the sense of the contract
    return back.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", kind.alias("record_type"), F.col("refers_key").cast("long").alias("refers_to"), F.col("record_type").alias("warc_type"))


#: Payload digests in base 32 from the hexadecimal SHA-1, five bits a letter.
OP2_SQL = """
WITH p AS (SELECT page_id, url, starts_with(coalesce(html, ''), 'HTTP/') AS web, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, url, web, octet_length(b) AS n, sha1(b) AS x FROM p),
m AS (SELECT x, max(page_id) AS head FROM h GROUP BY x),
d AS (SELECT x, head, list_transform(range(1, 40, 5), lambda i: CAST(('0x' || substr(x, i, 5)) AS BIGINT)) AS v FROM m),
e AS (SELECT x, head, array_to_string(list_transform(v, lambda g: array_to_string(list_transform([32768, 1024, 32, 1], lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((g // q) % 32 AS INTEGER), 1)), '')), '') AS d32 FROM d)
SELECT h.page_id, CAST(h.n AS BIGINT) AS payload_bytes, e.d32 AS payload_digest,
       CASE WHEN h.page_id = e.head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN h.page_id = e.head THEN NULL ELSE e.head END AS refers_to,
       CASE WHEN h.page_id <> e.head THEN 'revisit' WHEN regexp_matches(coalesce(h.url, ''), '^https?://', 'i') OR h.web THEN 'response' ELSE 'resource' END AS warc_type
FROM h JOIN e ON e.x = h.x
"""
