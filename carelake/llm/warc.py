"""WARC archives: writing with segmentation, reading with segment reassembly.

A payload goes into an HTTP response block with chunked transfer framing. A block
longer than a segment is cut: the first segment is a record of its type, the
others are continuation records that name it as their origin and carry a number,
the last one also the total length. Reading groups continuation records by
origin, orders them by number, verifies numbers and total length, and decodes the
framing. Archives are written by Spark's own committed writer, so a lost executor
leaves no half archive, and on any file system that Spark knows.

Of records with equal payloads of min_revisit bytes or more the one with the
smallest id is the response, the others are revisits without a payload; smaller
ones are all responses. Rows that repeat the smallest id are responses too.

Cases: a null payload is empty; a null id is never a revisit nor referred to; null
urls are written as an empty target; records with missing or surplus segments or
a wrong length come back with ok false and no payload; what follows a record that
can't be told from the next one (no header, no length, a cut file) comes back as
one row of type broken with ok false; field names have no case and may be folded;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, new_path, written

SEGMENT, CHUNK, MIN_REVISIT = 1 << 15, 1 << 12, 100
#: Bytes of a header at most.
MAX_HEAD = 1 << 20
EOL = b"\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(EOL, at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != EOL:
            raise ValueError("a chunk has the wrong length")
        out.append(body[at : at + n])
        at += n + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record but for the last line end, which the writer of lines adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + EOL + block + EOL


def inflated(data: memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a file piece by piece; gzip members are inflated as they come."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield bytes(data[at : at + step])
        return
    left, at, member = b"", 0, zlib.decompressobj(31)
    while at < len(data) or left:
        piece = left or bytes(data[at : at + step])
        at += 0 if left else step
        out = member.decompress(piece, step * 4)
        left = member.unconsumed_tail
        if member.eof:
            left, member = member.unused_data, zlib.decompressobj(31)
        if out:
            yield out


def _fields(head: bytes) -> dict[str, str]:
    """The named fields of a header, by their names in lower case; ValueError if it is none."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict[str, str] = {}
    name = ""
    for x in lines[1:]:
        if x[:1] in (" ", "\t") and name:
            out[name] += " " + x.strip()
        else:
            name, _, value = x.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


BROKEN = {"warc-type": "broken", "warc-record-id": ""}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a file given in pieces; no more than a record and a piece are held."""
    held = bytearray()

    def more() -> bool:
        try:
            held.extend(next(pieces))
            return True
        except (StopIteration, zlib.error):
            return False

    while True:
        while held[:2] == EOL:
            del held[:2]
        if len(held) < 2 or held[:2] == EOL:
            if more():
                continue
            if held:
                yield BROKEN, b""
            return
        at, seen = held.find(b"\r\n\r\n"), 0
        while at < 0 and len(held) <= MAX_HEAD:
            seen = max(0, len(held) - 3)
            if not more():
                break
            at = held.find(b"\r\n\r\n", seen)
        try:
            if at < 0:
                raise ValueError("a header has no end")
            fields = _fields(bytes(held[:at]))
            n = int(fields["content-length"])
            if n < 0:
                raise ValueError("a block has no length")
            while len(held) < at + 4 + n:
                if not more():
                    raise ValueError("the file is cut")
        except (KeyError, ValueError):
            yield BROKEN, b""
            return
        yield fields, bytes(held[at + 4 : at + 4 + n])
        del held[: at + 4 + n]


def _written(batches, segment: int, chunk: int):
    """Rows (id, row, url, payload, digest, refers) become records."""
    for b in batches:
        out: list[bytes] = []
        for i, row, url, payload, digest, refers in zip(*(b.column(k).to_pylist() for k in range(6))):
            name = f"<urn:row:{row}>"
            common = [("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Row-ID", "" if i is None else i), ("WARC-Payload-Digest", f"sha256:{digest}")]
            if refers is not None:
                out.append(record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Row-ID", refers)], b"HTTP/1.1 200 OK\r\n\r\n"))
                continue
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked((payload or "").encode(), chunk)
            parts = [block[k : k + segment] for k in range(0, len(block), segment)]
            for n, part in enumerate(parts, 1):
                more = [("WARC-Segment-Number", n)] if len(parts) > 1 else []
                if n > 1:
                    more += [("WARC-Segment-Origin-ID", name)]
                if n > 1 and n == len(parts):
                    more += [("WARC-Segment-Total-Length", len(block))]
                kind = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", name if n == 1 else f"<urn:row:{row}:{n}>")]
                out.append(record([*kind, *common, *more], part))
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write(df: DataFrame, path: str, id_: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT, segment: int = SEGMENT, chunk: int = CHUNK, records_a_file: int = 20_000) -> None:
    """Writes gzipped archives of the rows' payloads into the folder path."""
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(url).cast("string").alias("url"), text.alias("payload"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("n"))
    slim = rows.where(F.col("id").isNotNull() & (F.col("n") >= min_revisit)).select("id", "digest")
    first = slim.groupBy("digest").agg(F.min("id").alias("refers"), F.max("id").alias("last")).where("refers < last").drop("last")
    again = slim.join(first, "digest").where("id > refers").select("id", "digest", "refers").distinct()
    rows = rows.join(again, ["id", "digest"], "left").select("id", F.monotonically_increasing_id().alias("row"), "url", "payload", "digest", "refers")
    lines = rows.mapInArrow(lambda b: _written(b, segment, chunk), "record binary")
    lines.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def _parsed(batches):
    names = ["id", "kind", "name", "origin", "segment", "total", "digest", "refers", "block"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: int(x) if x and x.strip("-").isdigit() else None
    for b in batches:
        for data in b.column(0):
            rows, size = [], 0
            for f, block in records(inflated(memoryview(data.as_buffer()))):
                rows.append((number(f.get("row-id")), f.get("warc-type"), f.get("warc-record-id"), f.get("warc-segment-origin-id"), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), f.get("warc-payload-digest", "").rpartition(":")[2], number(f.get("refers-to-row-id")), block))
                size += len(block)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


def _decoded(batches):
    for b in batches:
        names = b.schema.names
        out: list[bytes | None] = []
        for kind, block in zip(b.column(names.index("kind")).to_pylist(), b.column(names.index("block"))):
            if kind == "revisit" or not block.is_valid:
                out.append(None)
                continue
            head, gap, body = block.as_buffer().to_pybytes().partition(b"\r\n\r\n")
            try:
                if not gap:
                    raise ValueError("no header")
                out.append(unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body)
            except (ValueError, zlib.error):
                out.append(None)
        yield b.drop_columns(["block"]).append_column("payload", pa.array(out, pa.binary()))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, record_type, name, digest, refers, payload, ok) of the archives in a folder; segments are put together."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(_parsed, "id long, kind string, name string, origin string, segment int, total long, digest string, refers long, block binary")
    whole = parsed.where("segment is null").select("id", "kind", "name", "digest", "refers", "block")
    cut = parsed.where("segment is not null").groupBy(F.coalesce("origin", "name").alias("name")).agg(
        F.max("total").alias("total"), F.count("*").alias("n"), F.max("segment").alias("last"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        *[F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c) for c in ("id", "kind", "digest", "refers")],
    )  # one record's segments: together no longer than its payload, a single value of the result
    # segments 1 to n, each once, and as long together as the last one says
    block = F.array_join(F.transform("parts", lambda x: x["block"].cast("string")), "").cast("binary")  # strings of raw bytes
    numbered = F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1), F.col("n").cast("int"))
    good = (F.col("last") == F.col("n")) & numbered & (F.octet_length("block") == F.col("total")) & F.col("kind").isNotNull()
    cut = cut.withColumn("block", block).select("id", "kind", "name", "digest", "refers", F.when(F.coalesce(good, F.lit(False)), F.col("block")).alias("block"))
    both = whole.unionByName(cut).mapInArrow(_decoded, "id long, kind string, name string, digest string, refers long, payload binary")
    return both.withColumnRenamed("kind", "record_type").withColumn("ok", (F.col("record_type") == "revisit") | (F.col("payload").isNotNull() & (F.sha2("payload", 256) == F.col("digest"))))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages (page_id, url, html) and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, ok."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, **options)
    got = read(spark, path).select("id", "record_type", "digest", "refers", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("actual"), "ok")
    got = written(got, "records")
    drop_path(spark, path)
    base = got.where("record_type = 'response' and id is not null and ok").groupBy(F.col("id").alias("refers"), F.col("actual").alias("digest")).agg(F.max("n").alias("base"))
    out = got.join(base, ["refers", "digest"], "left")
    again = F.col("record_type") == "revisit"
    return out.select(
        F.col("id").alias("page_id"), F.when(again, F.col("base")).otherwise(F.col("n")).alias("payload_bytes"), F.when(again, F.when(F.col("base").isNotNull(), F.col("digest"))).otherwise(F.col("actual")).alias("payload_digest"),
        "record_type", F.col("refers").alias("refers_to"), F.when(again, F.col("base").isNotNull()).otherwise(F.col("ok")).alias("ok"),
    )
