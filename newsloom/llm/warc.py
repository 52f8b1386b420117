"""WARC archives: a writer with revisit records, and a salvage reader that recovers what follows damage.

Archives are gzip members, one a record; the reader also takes members of many records and uncompressed archives. It
checks each record (member checksum, version line, header lines, length, end mark, block digest). After a failed check
it searches for the next member or version line that begins a valid record, within a member's inflated bytes as well
as in the archive, goes on from there, and logs the bytes between as a quarantined gap. Of a member that breaks off or
fails its checksum, the records that are whole and match their own digests are kept.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.shared import materialize

#: Payloads of fewer bytes are never revisits.
LEAST_PAYLOAD = 100
#: Compressed bytes after which a new archive begins; readers hold one archive at a time.
ARCHIVE_BYTES = 8 << 20
#: Fixed values of the format.
VERSION, END, HTTP_HEAD = b"WARC/1.1\r\n", b"\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[01]\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

#: Bytes of a member that are inflated at a time, and bytes that a record's header may take.
SLICE, HEAD = 1 << 16, 1 << 20

RECORDS = (
    "path string, begin bigint, finish bigint, inner_begin bigint, inner_finish bigint, gap string, record_type string, record_id string, refers_to_id string, "
    "target_uri string, payload_bytes bigint, payload_digest string, payload binary"
)


@dataclass
class Record:
    """begin and finish are bytes of the archive; inner ones those of a compressed member's inflated bytes."""

    begin: int
    finish: int
    fields: dict[str, str]
    block: bytes
    verified: bool = False
    inner_begin: int | None = None
    inner_finish: int | None = None

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head, or the block where there is none."""
        return self.block.partition(END)[2] if self.block.startswith(b"HTTP/") else self.block


@dataclass
class Gap:
    begin: int
    finish: int
    reason: str
    inner_begin: int | None = None
    inner_finish: int | None = None


class Damaged(ValueError):
    pass


def record_bytes(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """An uncompressed record: a response with its payload, or a revisit that names the response's record."""
    block = HTTP_HEAD if refers_to else HTTP_HEAD + payload
    fields = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date}
    if uri is not None:
        fields["WARC-Target-URI"] = uri.replace("\r", "%0D").replace("\n", "%0A")
    if refers_to:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers_to}>", "X-Payload-Length": str(len(payload))}
    fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode("utf-8", "replace") + b"\r\n" + block + END


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def parse_record(data: bytes, at: int = 0) -> Record:
    """The record that begins at `at`; raises Damaged at the first failed check."""
    if not VERSION_LINE.match(data[at : at + 10]):
        raise Damaged("version line")
    head = data.find(END, at, at + HEAD)
    if head < 0:
        raise Damaged("header end")
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("header line")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
        raise Damaged("required fields")
    begin = head + len(END)
    finish = begin + int(fields["content-length"])
    block = data[begin:finish]
    if data[finish : finish + 4] != END:
        raise Damaged("record end")
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        raise Damaged("block digest")
    return Record(at, finish + 4, fields, block, kind == "sha256")


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The inflated bytes of the member at `at`, as far as they go; where it ends or breaks off; the failed check, if any.

    The input is fed in slices, so that a member costs no more than its own bytes. A member that breaks is read again
    with a copy of the state at every slice, so that what came before the break is kept.
    """
    opener, view, plain, begin = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while at < len(data) and not opener.eof:
            piece = view[at : at + SLICE]
            plain.append(opener.decompress(piece))
            at += len(piece) - len(opener.unused_data)
        return b"".join(plain), at, "" if opener.eof else "member end"
    except zlib.error as error:
        failed = "member checksum" if "check" in str(error) else "member"
    opener, plain, at = zlib.decompressobj(31), [], begin
    while True:
        piece, before = view[at : at + SLICE], opener.copy()
        try:
            plain.append(opener.decompress(piece))
        except zlib.error:
            return b"".join([*plain, _upto_break(before, piece)]), at, failed
        at += len(piece)


def _upto_break(opener, piece: memoryview) -> bytes:
    """What a slice yields before the byte at which it breaks: halves are tried, so that few bytes are inflated twice."""
    out, at, size = [], 0, len(piece)
    while at < len(piece) and size:
        kept = opener.copy()
        try:
            out.append(opener.decompress(piece[at : at + size]))
            at += size
        except zlib.error:
            opener, size = kept, size // 2
    return b"".join(out)


def _next(pattern: re.Pattern, data: bytes, at: int) -> int:
    found = pattern.search(data, at)
    return found.start() if found else len(data)


def salvage_plain(data: bytes) -> Iterator[Record | Gap]:
    """Records of inflated bytes and the gaps between them: after a failed check, the next version line that begins a valid record."""
    at, lost, reason = 0, None, ""
    while at < len(data):
        try:
            record = parse_record(data, at)
        except Damaged as error:
            if lost is None:
                lost, reason = at, str(error)
            at = _next(VERSION_LINE, data, at + 1)
            continue
        if lost is not None:
            yield Gap(lost, at, reason)
            lost = None
        yield record
        at = record.finish
    if lost is not None:
        yield Gap(lost, len(data), reason)


def _member(data: bytes, at: int) -> tuple[list[Record | Gap], int, str]:
    """What the member at `at` holds, where it ends (or breaks off), and the failed check of the member itself, if any.

    Of a broken member only records that match their own digests count; whatever it lacks belongs to the gap of the
    member. A member without any record is damaged.
    """
    plain, finish, failed = inflate(data, at)
    found: list[Record | Gap] = []
    for x in salvage_plain(plain):
        if failed and (isinstance(x, Gap) or not x.verified):
            continue
        inner = x.begin, x.finish
        found.append(replace(x, begin=at, finish=finish, inner_begin=inner[0], inner_finish=inner[1]))
    if not failed and not any(isinstance(x, Record) for x in found):
        return [], finish, "record in member" if plain else "empty member"
    return found, finish, failed


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of an archive, compressed or not, and the gaps between them, in order of their bytes.

    A broken member's records come before its gap. The next member is sought from its second byte on, since a member
    that breaks off may run on into the next; the next version line from where its bytes were last read, so that no
    record is found twice. Both searches only go forward, so the time is in proportion to the archive.
    """
    at, lost, reason = 0, None, ""
    member, line, least_line = -1, -1, 0
    while at < len(data):
        records: list[Record | Gap] = []
        if data.startswith(MEMBER, at):
            records, finish, failed = _member(data, at)
        else:
            failed = ""
            try:
                records = [parse_record(data, at)]
                finish = records[0].finish
            except Damaged as error:
                failed = str(error)
        if records and lost is not None:
            yield Gap(lost, at, reason)
            lost = None
        yield from records
        if not failed:
            at = finish
            continue
        if lost is None:
            lost, reason = at, failed
        if records:
            least_line = max(least_line, finish)
        if member <= at:
            member = data.find(MEMBER, at + 1)
            member = len(data) if member < 0 else member
        if line <= at or line < least_line:
            line = _next(VERSION_LINE, data, max(at + 1, least_line))
        at = min(member, line)
    if lost is not None:
        yield Gap(lost, len(data), reason)


def plan_records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """pages -> page_id, url, html, digest, refers_to (null: a response).

    Digests alone are grouped, map-side combined, and joined back to their short rows; the payloads move once, by
    page_id, which no group of copies can skew.
    """
    body = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"))
    prints = materialize(pages.where(F.octet_length("html") >= least).select("page_id", "digest"))
    first = prints.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = prints.join(first, "digest").where("page_id <> refers_to").distinct()
    return pages.join(again, ["page_id", "digest"], "left")


def _record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None or pd.isna(page_id) else int(page_id)}"


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> int:
    """Writes the planned records as archives into a folder that all executors share; returns the number of records.

    Rows are sorted within each task, so a task that runs again writes the same archives under the same names; each
    appears at once, by a move.
    """

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, count, total = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []

        def close() -> None:
            nonlocal held, count
            if held:
                name, new = f"{root}/part-{part:06d}-{count:05d}.warc.gz", f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(new) as out:
                    for x in held:
                        out.write(x)
                if store.get_file_info(name).type != fs.FileType.NotFound:
                    store.delete_file(name)
                store.move(new, name)
                held, count = [], count + 1

        size = 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["refers_to"]):
                target = None if pd.isna(refers_to) else _record_id(refers_to)
                held.append(member(record_bytes(_record_id(page_id), url, html.encode("utf-8", "replace"), digest, target, date)))
                size += len(held[-1])
                total += 1
                if size >= archive_bytes:
                    close()
                    size = 0
        close()
        yield pd.DataFrame({"n": [total]})

    rows = records.select("page_id", "url", "html", "digest", "refers_to").sortWithinPartitions("page_id", "digest")
    # A null id would turn a batch's column into floats, which hold no large ids; text does.
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return rows.mapInPandas(written, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Every archive of a folder through the salvage reader: a row per record, and a row per quarantined gap.

    Records: gap is null; begin and finish are the bytes in the archive, inner_begin and inner_finish those in the
    inflated member (null where the archive isn't compressed). Gaps: `gap` names the first failed check and only these
    places are set; a gap within a member has inner places. payload=False leaves the payload bytes out.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for x in salvage(bytes(content)):
                    if isinstance(x, Gap):
                        rows.append((path, x.begin, x.finish, x.inner_begin, x.inner_finish, x.reason, *[None] * 7))
                        continue
                    f, body = x.fields, x.payload
                    kind, revisit = f["warc-type"], f["warc-type"] == "revisit"
                    size = int(f.get("x-payload-length", 0)) if revisit else len(body)
                    digest = f.get("warc-payload-digest", "").partition(":")[2] if revisit else hashlib.sha256(body).hexdigest()
                    ids = [f[k].strip("<>") if k in f else None for k in ("warc-record-id", "warc-refers-to")]
                    rows.append((path, x.begin, x.finish, x.inner_begin, x.inner_finish, None, kind, *ids, f.get("warc-target-uri"), size, digest, body if payload else None))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")]).astype({"payload_bytes": "Int64", "inner_begin": "Int64", "inner_finish": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select("path", "content").mapInPandas(read, RECORDS)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes `pages` as archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Of equal payloads of at least 100 bytes the smallest page_id is the response; the
    repeated rows of that id are responses as well, and so is every row without an id. Null urls leave the field out.
    An empty table writes no archive and gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    columns = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if not write_archives(plan_records(pages), folder):
        return spark.createDataFrame([], columns)
    records = read_archives(spark, folder, payload=False).where("gap IS NULL")
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("bigint")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))
