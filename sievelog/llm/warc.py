"""WARC archives: a writer of one gzip member a record, and a reader that splits archives at any byte.

The writer's tasks put archives into a shared folder and return their names; a name counts only once its task has
succeeded, so a task that is run again leaves a file nobody reads. The reader cuts archives into byte ranges. A task
looks for the gzip magic from its start on, takes a candidate for a record when its header decodes to a WARC header,
owns the records that start inside its range and reads them to their end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from sievelog.llm.common import add_fields, per_batch, salted_groups, text_of
from sievelog.sources.store import materialise, scratch_dir

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive before the writer starts the next, bytes of a reader's range, bytes read at once.
ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES = 256 << 20, 4 << 20, 1 << 20


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _clean(value: str) -> str:
    """A header value stays on its line."""
    return " ".join(value.split())


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds no payload but its length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"\r\n" if revisit else http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Target-URI", _clean(url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", str(len(block)))]
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to is not None:
            head.append(("WARC-Refers-To-Page", str(refers_to)))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload, digest, refers_to, revisit) as archives in a shared folder; a row per archive
    that counts: path, bytes, records. No rows give no archive."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is not None and size >= archive_bytes:
                    out.close()
                    done.append((path, size, count))
                    out, size, count = None, 0, 0
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                raw = member(r["page_id"], r["url"], r["payload"].encode(), r["digest"], r["refers_to"], r["revisit"])
                out.write(raw)
                size, count = size + len(raw), count + 1
        if out is not None:
            out.close()
            done.append((path, size, count))
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "bytes", "records"])

    names = ["page_id", "url", "payload", "digest", "refers_to", "revisit"]
    return materialise(rows.select(*names).mapInArrow(run, "path string, bytes long, records long"), "archives")


def header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a WARC header and its length, or None."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    return (fields, end + 4) if fields.get("Content-Length", "").isdigit() else None


def records(source, start: int, end: int, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the records that start in [start, end) of an open file."""
    size, at, held, base = source.size(), start, b"", start

    def fill(upto: int) -> None:
        """Holds the bytes from base on as far as upto, if there are so many."""
        nonlocal held
        want = min(upto, size) - base - len(held)
        if want > 0:
            source.seek(base + len(held))
            held += source.read(max(want, min(read_bytes, size - base - len(held))))

    while at < min(end, size):
        held, base = held[at - base:], at
        fill(at + read_bytes)
        found = held.find(MAGIC)
        if found < 0:
            at = base + max(len(held) - 2, 1)
            continue
        at = base + found
        if at >= end:
            return
        held, base = held[found:], at
        unpack, raw, used, head = zlib.decompressobj(31), [], 0, None
        try:
            while not unpack.eof:
                fill(base + used + read_bytes)
                piece = held[used:used + read_bytes]
                if not piece:
                    raise zlib.error("cut off")
                raw.append(unpack.decompress(piece))
                used += len(piece) - len(unpack.unused_data)
                if head is None and (sum(map(len, raw)) > 1 << 16 or unpack.eof):
                    raw = [b"".join(raw)]
                    head = header(raw[0])
                    if head is None:
                        raise zlib.error("no WARC header")
            whole = b"".join(raw)
            head = header(whole)
            long = int(head[0]["Content-Length"])
            if len(whole) < head[1] + long:
                raise zlib.error("short block")
        except (zlib.error, ValueError):
            at += 1  # the magic stood inside a record that another range owns
            continue
        yield at, head[0], whole[head[1]:head[1] + long]
        at += used


def read(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of archives (path, bytes): page_id, url, payload_bytes, payload_digest, record_type, refers_to. Digest and
    length of a response are taken from its payload, those of a revisit from its header."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        store, _ = fs.FileSystem.from_uri(folder)
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                with store.open_input_file(r["path"]) as source:
                    for _, h, block in records(source, r["start"], r["start"] + range_bytes):
                        kind = h["WARC-Type"]
                        length, digest = int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4:]
                            if (len(payload), base32_sha1(payload)) != (length, digest):
                                raise ValueError(f"a payload in {r['path']} was changed")
                        rows.append((number(h.get("WARC-Page-ID")), h["WARC-Target-URI"], length, digest, kind, number(h.get("WARC-Refers-To-Page"))))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                          ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))
    ranges = archives.select("path", F.explode(starts).alias("start"))
    dealt = ranges.repartition(F.col("path"), F.col("start"))
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def payloads(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest and a row number, stored: what decides and what is written are the same rows."""
    import pyarrow as pa
    udf = per_batch(lambda texts: [(base32_sha1(t.encode()),) for t in texts], "digest string", [pa.string()])
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_of(html).alias("payload"))
    return materialise(add_fields(rows, udf(F.col("payload")), ["digest"]).withColumn("_row", F.monotonically_increasing_id()), "payloads")


def archive(pages: DataFrame, min_bytes: int = 0, **columns: str) -> tuple[DataFrame, str]:
    """Writes all pages to a new folder of archives: (archives, folder).

    Of records with equal payloads of at least `min_bytes` bytes, that with the largest page_id is the response and the
    others revisit it; a null page_id is smaller than any, and of rows that repeat the largest one is the response.
    Smaller payloads are all responses. Null html is an empty payload.
    """
    rows = payloads(pages, **columns)
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("rank"), F.col("page_id").alias("id"), F.col("_row").alias("row"))
    groups = salted_groups(rows.select("digest", "_row", "page_id").withColumn("_order", order), ["digest"], F.col("_row"), {"_last": ("max", "_order")})
    revisits = groups.filter(F.col("_last.row") != F.col("_row")).select("_row", F.col("_last.id").alias("refers_to"), F.lit(True).alias("revisit"))
    small = F.octet_length("payload") < min_bytes
    found = rows.join(revisits, "_row", "left").withColumns({
        "revisit": F.coalesce(F.col("revisit"), F.lit(False)) & ~small, "refers_to": F.when(~small, F.col("refers_to"))})
    folder = f"{scratch_dir(pages.sparkSession).rstrip('/')}/sievelog-warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return write(found, folder), folder


def round_trip(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes the pages as archives and reads them back: one row per page. An empty table gives no rows; other columns
    are not read, so they can't clash."""
    archives, folder = archive(pages, min_bytes, **columns)
    return read(archives, folder)
