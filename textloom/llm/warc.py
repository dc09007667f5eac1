"""WARC archives: a writer with identical-payload revisits, and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range of a file: it looks for the
gzip magic, accepts a place only if the member there inflates to a WARC header, whatever its length, and then owns every record that starts inside its
range, the last of which may end beyond it. From an accepted record on, members follow one another without
searching. Files are written whole under new names; a table lists those whose tasks succeeded, and only they are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_bytes, write_whole
from .shared import bounded_batches, join_salted, materialise, new_table_path

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def _page(record_id: str | None) -> int | None:
    """The page of this module's record ids; other ids have none."""
    scheme, _, text = (record_id or "").strip("<>").rpartition(":")
    return int(text) if scheme == "urn:x-page" and text else None


def record(page, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a response, or with a revisit that names the response of the same payload."""
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": "sha1:" + digest_of(payload),
        "X-Payload-Length": str(len(payload)),
    }
    if url:
        fields["WARC-Target-URI"] = "".join(url.split())
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to)}
    block = HTTP if revisit else HTTP + payload
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8") + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {name.strip(): value.strip() for name, _, value in pairs}
    return fields, rest[: int(fields["Content-Length"])]


VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
#: Bytes of a member that are read and inflated at first to judge its header; each further step takes twice as many.
HEADER_READ = 16 << 10


def header_verdict(head: bytes) -> bool | None:
    """Whether ``head`` begins with a record's header; None while it may, and more has to be read.

    A header is a version line, then named fields up to a blank line, among them a type, a record id and a length. It may be of any length.
    """
    if not head.startswith(VERSIONS):
        return None if any(v.startswith(head) for v in VERSIONS) else False
    blank = head.find(b"\r\n\r\n")
    lines = bytes(head[len(VERSIONS[0]) : blank if blank >= 0 else max(head.rfind(b"\r\n"), len(VERSIONS[0]))]).split(b"\r\n")
    fields = {}
    for line in lines if lines != [b""] else []:
        name, colon, value = line.partition(b":")
        if not colon and not line.startswith((b" ", b"\t")):  # a folded line goes on with the one before
            return False
        fields[name.strip().lower()] = value.strip()
    if blank < 0:
        return None
    return bool(fields.get(b"warc-type")) and bool(fields.get(b"warc-record-id")) and fields.get(b"content-length", b"").isdigit()


def is_record_header(head: bytes) -> bool:
    return header_verdict(head) is True


def _damaged(whole: bytes) -> bool:
    """A member that isn't a record, but has a record's version line and one of its fields."""
    return whole.startswith(VERSIONS) and b"\nwarc-" in whole[: whole.find(b"\r\n\r\n")].lower()


def _starts_record(f, at: int) -> bool:
    """Inflates step by step, until the header ends or can't be one."""
    f.seek(at)
    inflater, head, step = zlib.decompressobj(31), bytearray(), HEADER_READ
    try:
        while not inflater.eof:
            data = inflater.unconsumed_tail or f.read(step)
            part = inflater.decompress(data, step)
            if not data and not part:
                return False
            head += part
            verdict = header_verdict(head)
            if verdict is not None:
                return verdict
            step *= 2
    except zlib.error:
        pass
    return False


def _first_record(f, start: int, end: int) -> int:
    """The first place in [start, end) where a record starts, or -1."""
    at = start
    while at < end:
        f.seek(at)
        data = f.read(min(READ_BYTES, end - at) + len(MAGIC) - 1)
        k = data.find(MAGIC)
        while k >= 0 and at + k < end:
            if _starts_record(f, at + k):
                return at + k
            k = data.find(MAGIC, k + 1)
        at += min(READ_BYTES, end - at)
    return -1


def read_range(path: str, start: int, end: int):
    """(offset, header fields, block) of every record that starts in [start, end)."""
    with open_bytes(path) as f:
        at = _first_record(f, start, end)
        while 0 <= at < end:
            f.seek(at)
            inflater, parts, used = zlib.decompressobj(31), [], 0
            while not inflater.eof:
                data = f.read(READ_BYTES)
                if not data:
                    raise ValueError(f"{path} ends inside the record at {at}")
                parts.append(inflater.decompress(data))
                used += len(data)
            whole = b"".join(parts)
            if is_record_header(whole):  # members of other content between records are passed over
                yield at, *parse_record(whole)
            elif _damaged(whole):
                raise ValueError(f"{path} has a record at {at} whose header can't be read")
            at += used - len(inflater.unused_data)
            f.seek(at)
            if f.read(len(MAGIC)) != MAGIC:  # the end, or something between members
                at = _first_record(f, at, end)


def write_archives(pages: DataFrame) -> DataFrame:
    """Write all pages; (path, size) of each archive. See ``archive_pages`` for the rules."""
    folder = new_table_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).alias("html")
    rows = bounded_batches(pages).select("page_id", "url", payload).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    newest = rows.groupBy("sha1").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n")
    # salted: a payload that a third of the rows share is no long key
    known = join_salted(rows.withColumn("_spread", F.xxhash64("page_id", "url")), newest, ["sha1"], "_spread", "left").select("page_id", "url", "html", "newest")

    def run(batches):
        def records():
            for batch in batches:
                for row in batch.to_pylist():
                    revisit = row["newest"] is not None and row["page_id"] != row["newest"]
                    yield record(row["page_id"], row["url"], row["html"].encode("utf-8"), row["newest"], revisit)

        stream = records()
        first = next(stream, None)
        if first is not None:
            import itertools

            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            size = write_whole(path, itertools.chain([first], stream))
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size]})

    return materialise(known.mapInArrow(run, "path string, size long"), "warc-files")


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload (null for revisits).

    A response's length and digest are those of the bytes read, which must match its header. ``files``: path, size.

    Records of other writers have a null page_id and keep the digest of their header. Where it or X-Payload-Length is missing,
    it comes from the payload: the block, of HTTP messages what follows their header; a revisit has none, so a null stays.
    """
    splits = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    partitions = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for split in batch.to_pylist():
                columns, held = [[] for _ in names], 0
                for _, fields, block in read_range(split["path"], split["start"], split["start"] + split_bytes):
                    kind, digest, size, payload = fields.get("WARC-Type"), fields.get("WARC-Payload-Digest"), fields.get("X-Payload-Length"), None
                    digest, size, own = digest and digest.removeprefix("sha1:"), None if size is None else int(size), size is not None
                    if kind != "revisit":
                        http = fields.get("Content-Type", "").startswith("application/http")
                        payload = block.partition(b"\r\n\r\n")[2] if http else block
                        if own and (len(payload) != size or digest is not None and digest_of(payload) != digest):
                            raise ValueError(f"damaged record {fields.get('WARC-Record-ID')} in {split['path']}")
                        digest, size = digest or digest_of(payload), len(payload)
                    row = (_page(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), kind, _page(fields.get("WARC-Refers-To")), digest, size, payload)
                    for out, value in zip(columns, row):
                        out.append(value)
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], names)
                        columns, held = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], names)

    return splits.repartition(partitions).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """One row per page, from archives written and read back.

    Of pages with equal payloads (null html: empty), the one with the largest page_id is the response and the others
    revisit it; rows that repeat that page_id are responses too. A null page_id is never the response of a group
    with other ids. White space inside a url goes; a url of any length is kept; a null url is left out of the record. A null or empty html is an empty payload, a
    very long one is one record. An empty table gives no rows, and other columns take no part. page_id must be a whole number.
    """
    return read_archives(write_archives(pages)).drop("payload")
