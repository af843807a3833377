"""WARC archives: writing, normalising monolithic gzip files, and reading through a sidecar index.

``write_archives`` puts a record for every page into archives that are each one gzip stream, as many crawlers leave them.
``normalise`` inflates such a stream once, from front to back, writes every record as its own gzip member and a sidecar
index of (offset, length, record id, type, uri, digest), so any record can be read by one seek. ``read_archives`` reads
the records through that index.

Files go to the shared folder under names that no other attempt uses; only names that reached a saved manifest count, so a
task that is lost, or run twice, leaves at most an unused file.

Defined cases: null html is an empty payload; payloads below 100 bytes are always responses; of equal larger payloads the
smallest page_id is the response and the others revisit it (repeated rows of that page_id are all responses, rows of one
page_id with different payloads go each by their own); a row without a page_id revisits like any other, and is a response
where no row with its payload has an id; a null url is named after the page; an empty table gives no archives and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checked, filesystem, map_rows, save, shared_dir, table, text_or_empty

LEVEL = 3
#: An archive is closed when it holds so many bytes before compression.
ROLL_BYTES = 64 << 20
LEAST_REVISIT = 100
READ_BYTES = 1 << 20
MOST_TASKS = 20_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_name(page_id: int | None) -> str:
    return f"{PAGE}{'' if page_id is None else page_id}"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the headers of the response alone."""
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else page_name(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{page_name(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        return record(fields, http + payload)
    return record([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PAGE}{refers_to}>")], http)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload a smaller page_id holds. Only ids and digests are shuffled."""
    payload = text_or_empty("html").cast("binary")
    prints = save(
        pages.select(
            F.col("page_id").cast("long"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")
        ).where(F.col("bytes") >= LEAST_REVISIT).drop("bytes"),
        "warc-prints",
    )
    shared = prints.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checked(save(shared.drop("n"), "warc-shared"))
    again = prints.join(shared, "digest").where("refers_to is not null and not page_id <=> refers_to")
    return again.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all pages into archives of one gzip stream each; returns the saved manifest (path, records)."""
    def work(batches):
        import uuid

        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        out, done = None, []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch[n] for n in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, gz = files.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name.rsplit('/', 1)[1]}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(gz.compress(info))
                    size = records = 0
                data = page_record(page_id, url, html, digest, refers_to)
                out.write(gz.compress(data))
                size, records = size + len(data), records + 1
                if size >= roll_bytes:
                    out.write(gz.flush())
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
            done.append((name, records))
        yield {"path": [x[0] for x in done], "records": [x[1] for x in done]}

    verdicts = checked(save(revisits(pages), "warc-revisits"))
    payload = text_or_empty("html").cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest")).alias("p")
    same = F.col("p.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("p.digest") == F.col("v.digest"))
    rows = rows.join(verdicts.alias("v"), same, "left").select("p.*", "v.refers_to")
    return save(map_rows(rows, "path string, records long", work), "warc-manifest")


def inflate(stream):
    """Bytes of a gzip stream, piece by piece, whether it has one member or many."""
    gz = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            yield gz.decompress(data)
            data = gz.unused_data
            if gz.eof:
                gz = zlib.decompressobj(31)
            else:
                break


def split_records(pieces):
    """(header fields, whole record) of each record; holds one record at a time."""
    held, at, parts = bytearray(), 0, iter(pieces)

    def more() -> bool:
        nonlocal held, at
        piece = next(parts, None)
        if piece is None:
            return False
        if at:
            del held[:at]
            at = 0
        held += piece
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(held[at:]).strip():
                    raise ValueError("the archive ends within a header")
                return
        fields = {}
        for line in bytes(held[at:end]).decode().split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = end - at + 4 + int(fields["content-length"]) + 4
        while len(held) - at < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(held[at : at + size])
        at += size


def tasks_for(archives: DataFrame) -> int:
    """A task for each archive, up to a bound; beyond it tasks take several, one after another."""
    return max(1, min(MOST_TASKS, archives.count()))


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of a saved manifest; returns the saved (path, index_path, records) of the new files."""

    def work(batches):
        import uuid

        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        for batch in batches:
            done = {"path": [], "index_path": [], "records": []}
            for path in batch["path"]:
                source, inner = filesystem(path)
                name, offset, lines = uuid.uuid4().hex, 0, []
                with (
                    source.open_input_stream(inner, compression=None) as stream,
                    files.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out,
                    files.open_output_stream(f"{base}/{name}.idx", compression=None) as index,
                ):
                    for fields, whole in split_records(inflate(stream)):
                        gz = zlib.compressobj(LEVEL, wbits=31)
                        member = gz.compress(whole) + gz.flush()
                        out.write(member)
                        entry = [offset, len(member), fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-payload-digest")]
                        index.write(json.dumps(entry).encode() + b"\n")
                        offset += len(member)
                        lines.append(0)
                done["path"].append(f"{folder}/{name}.warc.gz")
                done["index_path"].append(f"{folder}/{name}.idx")
                done["records"].append(len(lines))
            yield done

    paths = manifest.select("path").repartition(tasks_for(manifest))
    return save(map_rows(paths, "path string, index_path string, records long", work), "warc-normalised")


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, path string, record_offset long"


def read_archives(normalised: DataFrame) -> DataFrame:
    """A row for each page record, read by the offsets of the sidecar index. The digest of a response is computed from
    the payload that was read and held against its header; a revisit has only its headers."""

    def page(ref: str) -> int | None:
        name = ref.strip("<>").removeprefix(PAGE)
        return int(name) if name else None

    def work(batches):
        import hashlib

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for path, index_path in zip(batch["path"], batch["index_path"]):
                (files, inner), (_, index) = filesystem(path), filesystem(index_path)
                out = {n: [] for n in names}
                with files.open_input_stream(index, compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with files.open_input_file(inner) as f:
                    for offset, length, _, kind, uri, _ in entries:
                        if kind not in ("response", "revisit"):
                            continue
                        f.seek(offset)
                        ((fields, whole),) = split_records(inflate_bytes(f.read(length)))
                        head, _, block = whole.partition(b"\r\n\r\n")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        stated = fields["warc-payload-digest"].removeprefix("sha256:")
                        size = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                        if kind == "response":
                            payload = payload[:-4]
                            if len(payload) != size or hashlib.sha256(payload).hexdigest() != stated:
                                raise ValueError(f"{path} at {offset}: payload and header differ")
                        refers = page(fields["warc-refers-to"]) if kind == "revisit" else None
                        for n, v in zip(names, (page(fields["warc-record-id"]), size, stated, kind, refers, uri, path, offset)):
                            out[n].append(v)
                        if len(out["page_id"]) >= 10_000:
                            yield out
                            out = {n: [] for n in names}
                yield out

    return map_rows(normalised.select("path", "index_path").repartition(tasks_for(normalised)), SCHEMA, work)


def inflate_bytes(member: bytes):
    import io

    return inflate(io.BytesIO(member))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc-crawl"))
    rows = read_archives(normalise(manifest, shared_dir(spark, "warc-members")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""
