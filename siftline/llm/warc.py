"""WARC archives: writing them, and reading them back by verified chains of record boundaries."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siftline.llm.common import id_in, id_out, text_in
from siftline.session import materialize, scratch_path

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
CLOSE = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

CANDIDATE = (
    "path string, block bigint, rel bigint, seen bigint, size bigint, leave bigint, body bigint, http boolean, "
    "record_type string, record string, refers_to string, uri string, named_digest string, payload_bytes bigint, payload_digest string"
)


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 SHA-1: five bytes of the digest at a time as a number in base 32."""
    digest = F.sha1(data)
    eights = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eights), BASE32_HEX, BASE32)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, file_records: int = 4096) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the
    smallest page_id is a response and the others are revisits of it, without a
    body; rows repeated with that id are responses too. Payloads are the html in
    UTF-8, null is empty; a null id is the smallest. Line ends and blanks in a URL are percent-encoded.
    """
    rows = pages.select(id_in("page_id").alias("id"), F.col("url"), text_in("html").alias("html"))
    rows = rows.withColumn("digest", sha1_base32(F.col("html").cast("binary")))
    copies = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # Written first: its size tells whether the payloads have to be shuffled to meet it.
    copies = materialize(copies.select("digest", "first"), "copies")
    rows = rows.join(copies, "digest", "left")
    revisit = (F.col("id") > F.col("first")) & (F.octet_length("html") >= least_bytes)
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), "html"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("id"),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z"),
        F.when(url.isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), url)).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block, F.lit("\r\n\r"),
    )
    # The writer's own line end completes the close of each record.
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", file_records).text(path)


def _header(segment: bytes) -> dict[str, str] | None:
    """Header fields of what follows a magic, with its length; None if it is no header."""
    end = segment.find(CLOSE)
    if end < 0:
        return None
    fields = {}
    for line in segment[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdecimal():
        return None
    fields["body"] = end + len(CLOSE)
    return fields


def payload_of(segment: bytes, body: int, http: bool) -> bytes:
    block = segment[body : -len(CLOSE)]
    return block[block.find(CLOSE) + len(CLOSE) :] if http and CLOSE in block else block


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _candidate(segment: bytes, rel: int, seen: int) -> dict:
    """What stands at a magic: its size if it is a record, and the payload's digest if the segment has it all."""
    out = {"rel": rel, "seen": seen}
    fields = _header(segment)
    if fields is None:
        return out
    out["body"], out["http"] = fields["body"], fields.get("content-type", "").startswith("application/http")
    out["size"] = len(MAGIC) + out["body"] + int(fields["content-length"]) + len(CLOSE)
    out["record_type"], out["record"] = fields.get("warc-type"), fields.get("warc-record-id")
    out["refers_to"], out["uri"] = fields.get("warc-refers-to"), fields.get("warc-target-uri")
    out["named_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if out["size"] == seen and segment.endswith(CLOSE):
        payload = payload_of(segment, out["body"], out["http"])
        out["payload_bytes"], out["payload_digest"] = len(payload), _digest(payload)
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes | None]]:
    """(path, block, place in the block, text after the magic) in file order; None ends a block.

    What a block holds before its first magic only occurs at the start of a file.
    """
    now, rel = None, 0
    for batch in batches:
        for path, block, value in zip(batch.column(0), batch.column(1), batch.column(2)):
            here = (path.as_py(), block.as_py())
            segment, before = value.as_py(), False
            if here != now:
                if now:
                    yield (*now, rel, None)
                now, rel, before = here, 0, here[1] == 0
            if before:
                if segment:
                    raise ValueError(f"{here[0]} does not begin with a record")
                continue
            yield (*here, rel, segment)
            rel += len(MAGIC) + len(segment)
    if now:
        yield (*now, rel, None)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate records of each block, each with the place where its chain leaves the block."""
    names = [f.split()[0] for f in CANDIDATE.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in CANDIDATE.split(", ")]
    rows: list[dict] = []
    for path, block, rel, segment in _segments(batches):
        if segment is not None:
            rows.append({"path": path, "block": block} | _candidate(segment, rel, len(MAGIC) + len(segment)))
            continue
        leaves: dict[int, int | None] = {}
        for row in reversed(rows):
            after = row["rel"] + row["size"] if "size" in row else None
            row["leave"] = leaves.get(after) if after is not None and after < rel else after
            leaves[row["rel"]] = row["leave"]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)
        rows = []


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _on_chain(table: pa.Table) -> pa.Table:
    """The candidates of a block that its entry's chain passes."""
    rel, size = table.column("rel").to_pylist(), table.column("size").to_pylist()
    place = {r: i for i, r in enumerate(rel)}
    at, kept = table.column("entry")[0].as_py(), []
    while at in place:
        kept.append(place[at])
        at += size[place[at]]
    return table.take(pa.array(kept, pa.int64()))


def scan_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``, without their payloads.

    Columns: path, at, size, record_type, record, refers_to, uri, named_digest (the header's),
    payload_bytes, payload_digest (of the payload itself). Archives are read in blocks of any size, cut at every magic.
    Each task emits its candidates with the offset of their successors and where the
    chain of successors leaves the block; jumping along those exits, doubling the
    jump each round, gives the entry of every block from the start of its file, and only
    candidates on the chain from an entry are records. A magic inside a payload is
    not, nor is a whole record quoted there. A chain that does not end at the end of
    its file raises an error. A payload cut by magics is put together from its segments.
    """
    found = materialize(_text(spark, path).mapInArrow(_candidates, CANDIDATE), "candidates")
    blocks = found.groupBy("path", "block").agg(F.sum("seen").alias("held"))
    order = Window.partitionBy("path").orderBy("block")
    blocks = blocks.select(
        "path", "block", "held", (F.sum("held").over(order) - F.col("held")).alias("base"),
        F.sum("held").over(Window.partitionBy("path")).alias("file_size"),
    )
    blocks = materialize(blocks, "blocks")
    placed = found.join(blocks, ["path", "block"]).withColumn("at", F.col("base") + F.col("rel"))
    exits = placed.where("leave is not null").select("path", "at", (F.col("base") + F.col("leave")).alias("to"))
    doors = exits.select("path", F.col("to").alias("at")).union(blocks.select("path", F.lit(0).cast("bigint").alias("at")))
    jump = materialize(exits.join(doors.distinct(), ["path", "at"]), "jumps")
    reached = materialize(doors.where("at = 0").distinct(), "reached")
    count = 0
    while (now := reached.count()) > count:
        count = now
        further = reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = materialize(reached.union(further).distinct(), "reached")
        then = jump.select("path", F.col("at").alias("to"), F.col("to").alias("end"))
        jump = materialize(jump.join(then, ["path", "to"]).select("path", "at", F.col("end").alias("to")), "jumps")
    ends = reached.join(blocks.select("path", F.col("file_size").alias("at")).distinct(), ["path", "at"]).count()
    if ends != blocks.select("path").distinct().count():
        raise ValueError(f"{path}: a chain of records does not end with its file")
    entries = reached.join(blocks, "path").where("at >= base and at < base + held")
    entries = entries.select("path", "block", "base", (F.col("at") - F.col("base")).alias("entry"))
    chained = found.join(entries, ["path", "block"])
    records = materialize(chained.groupBy("path", "block").applyInArrow(_on_chain, chained.schema), "records")
    records = records.withColumn("at", F.col("base") + F.col("rel"))
    columns = ["path", "at", "size", "record_type", "record", "refers_to", "uri", "named_digest", "payload_bytes", "payload_digest"]
    cut = records.where("seen < size")
    if cut.isEmpty():
        return records.select(*columns)
    return records.where("seen = size").select(*columns).union(_rejoin(spark, path, cut, placed).select(*columns))


def _rejoin(spark: SparkSession, path: str, cut: DataFrame, placed: DataFrame) -> DataFrame:
    """Records whose payload holds magics, with the digest over all their segments."""
    parts = cut.select("path", F.col("at").alias("start"), "size").join(
        placed.select("path", "block", "rel", "at"), "path"
    ).where("at >= start and at < start + size").select("path", "block", "rel", "start", "at")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block, rel, segment in _segments(batches):
            if segment is not None:
                yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "rel": [rel], "text": [segment]})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                text = MAGIC.encode().join(r.pop("texts"))
                payload = payload_of(text, r["body"], r["http"])
                r["payload_bytes"], r["payload_digest"] = len(payload), _digest(payload)
            yield pa.RecordBatch.from_pylist(rows, schema)

    held = _text(spark, path).join(parts.select("path", "block").distinct(), ["path", "block"], "left_semi")
    held = held.mapInArrow(texts, "path string, block bigint, rel bigint, text binary").join(parts, ["path", "block", "rel"])
    joined = held.groupBy("path", F.col("start").alias("at")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]).alias("texts")
    )
    full = cut.drop("payload_bytes", "payload_digest", "block", "rel", "seen", "leave", "entry", "base").join(joined, ["path", "at"])
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    out = [(f.name, f.dataType.simpleString()) for f in full.schema if f.name != "texts"]
    out += [("payload_bytes", "bigint"), ("payload_digest", "string")]
    schema = pa.schema([(n, kinds[k]) for n, k in out])
    return full.mapInArrow(whole, ", ".join(f"{n} {k}" for n, k in out))


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back, and tell what each record holds.

    (page_id, payload_bytes, payload_digest, record_type, refers_to) per row;
    figures of a revisit are those of the response that has the id it refers to and the digest it
    names, as rows with one id, or without, are several responses. An empty table gives an empty one. ``path`` is a new
    folder that all executors share; unset, one in the shared scratch folder.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, least_bytes)
    page = lambda name: F.regexp_extract(name, r"<urn:page:(-?\d+)>", 1).cast("bigint")
    records = scan_warc(spark, path)
    records = records.select(
        page("record").alias("id"), page(F.nullif("refers_to", F.lit(""))).alias("first"), "record_type", "payload_bytes",
        F.when(F.col("refers_to").isNull(), F.col("payload_digest")).otherwise(F.col("named_digest")).alias("digest"), "payload_digest",
    )
    records = materialize(records, "records")
    wanted = records.where("first is not null").select(F.col("first").alias("id"), "digest").distinct()
    told = records.where("first is null").join(wanted, ["id", "digest"], "left_semi")
    told = told.select(F.col("id").alias("first"), "digest", F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    return records.join(told.dropDuplicates(["first", "digest"]), ["first", "digest"], "left").select(
        id_out("id").alias("page_id"), F.coalesce("b", "payload_bytes").alias("payload_bytes"),
        F.coalesce("d", "payload_digest").alias("payload_digest"), "record_type", id_out("first").alias("refers_to"),
    )
