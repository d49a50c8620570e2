"""Legacy archives (ARC, versions 1 and 2) to WARC, and both read and written as plain folders of gzip files.

An ARC file opens with a version block that names the fields of its header lines; the last field of
every line is the length of what follows, so records are cut by declared lengths whatever their
bytes are. From a line come the WARC record's identifier (a name-based UUID of archive and
offset), its time stamp (any even number of digits from the year on), its type and its digests. Of HTTP records with
equal payloads one is a response, the others are written as revisits of it, without a payload.

Files are written by Spark's text writer: the separator behind a record is what the formats ask
for there. Archives roll over at ``ARCHIVE_BYTES`` of records, so one file fits a task; it is
read as one row and unpacked in pieces. Record ids, not payloads, are grouped to find revisits; what was decided
meets the archive by its path.

Null html is empty, null and blank urls are written ``-`` and left out of the WARC record; a null ``page_id`` is
written and read as none and comes after all others. Repeated rows are records of their own: of
equal ids the earlier record stays. An empty table gives an empty folder and no rows. Extra columns are ignored. Blanks,
control and non-ASCII characters of a url are percent-encoded. A record that is shorter than its declared length, or
whose payload differs from its digest, raises.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.llm.arrowtext import slices
from gridpanel.operators.skew import salted_join
from gridpanel.session import ensure_checkpoint_dir, written

#: Bytes of records after which a new archive begins.
ARCHIVE_BYTES = 64 << 20
#: Revisits (some 200 bytes each) that are sent to every task.
BROADCAST_REVISITS = 100_000
#: Bytes unpacked, or handed to Spark, at once.
PIECE = 1 << 20
BATCH = 4 << 20

# Header fields of the two versions, and what a WARC reader looks for.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"
_SAFE = "".join(map(chr, range(33, 127)))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Unpacked:
    """Lines and byte runs of a gzip file of one or more members, or of a plain one, unpacked piece by piece."""

    def __init__(self, packed: bytes):
        self.packed, self.gzip, self.at, self.offset, self.held = memoryview(packed), packed[:2] == b"\x1f\x8b", 0, 0, b""
        self.member = zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bool:
        while self.at < len(self.packed) or self.gzip and self.member.unconsumed_tail:
            if not self.gzip:
                new = bytes(self.packed[self.at : self.at + PIECE])
                self.at += len(new)
            else:
                fed = self.member.unconsumed_tail
                if not fed:
                    fed = bytes(self.packed[self.at : self.at + PIECE])
                    self.at += len(fed)
                new = self.member.decompress(fed, PIECE)
                if self.member.eof:  # the next member begins in what is left
                    self.at -= len(self.member.unused_data)
                    self.member = zlib.decompressobj(31)
            if new:
                self.held += new
                return True
        return False

    def line(self) -> bytes | None:
        """The next line without its end; None behind the last."""
        searched = 0
        while (end := self.held.find(b"\n", searched)) < 0:
            searched = len(self.held)
            if not self._more():
                if not self.held:
                    return None
                end = len(self.held)
                break
        told, self.held = self.held[:end], self.held[end + 1 :]
        self.offset += end + 1
        return told

    def run(self, size: int) -> bytes:
        parts, missing = [], size
        while missing:
            if not self.held and not self._more():
                raise ValueError(f"an archive ends {missing} bytes before a record does")
            parts.append(self.held[:missing])
            self.held = self.held[missing:]
            missing -= len(parts[-1])
        self.offset += size
        return b"".join(parts)


def arc_records(packed: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``(offset, version, header fields, block)`` of each record of an ARC file, the version block first."""
    file, version, names = Unpacked(packed), 0, ()
    while True:
        begin = file.offset
        line = file.line()
        if line is None:
            return
        if not line.strip():
            continue
        said = line.decode("latin-1").rstrip("\r")
        size = int(said.rsplit(" ", 1)[1])
        block = file.run(size)
        if said.startswith("filedesc:"):
            first, second = block.decode("latin-1").splitlines()[:2]
            version, names = int(first.split(" ")[0]), tuple(second.split(" "))
            if names != FIELDS.get(version):
                raise ValueError(f"unknown ARC version block: {first!r}, {second!r}")
        if not names:
            raise ValueError("an ARC file does not begin with a version block")
        values = said.rsplit(" ", len(names) - 1)  # an unescaped url may hold blanks
        yield begin, version, dict(zip(names, values)), block


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes] | None:
    """Header fields (lower-case), head and payload of an HTTP response; None if it is none."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [(at, len(gap)) for gap in (b"\r\n\r\n", b"\n\n") if (at := block.find(gap)) >= 0]
    at, gap = min(ends, default=(len(block), 0))
    lines = block[:at].decode("latin-1").splitlines()[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, block[: at + gap], block[at + gap :]


def warc_date(digits: str) -> str:
    """``2001``, ``20010203`` or ``20010203040506`` as ISO 8601; missing parts are the earliest."""
    if not digits.isdigit() or len(digits) < 4 or len(digits) % 2:
        raise ValueError(f"no archive date: {digits!r}")
    d = digits[:14] + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def _page(fields: dict[str, str]) -> int | None:
    said = fields.get(PAGE_HEADER.lower())
    return None if said is None else int(said)


class _Rows:
    """Collects rows for Spark and hands them on in batches of some bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.columns, self.size = schema, {n: [] for n in schema.names}, 0

    def add(self, size: int, *values) -> None:
        for column, value in zip(self.columns.values(), values):
            column.append(value)
        self.size += size + 64

    def full(self) -> bool:
        return self.size >= BATCH

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({n: pa.array(v, self.schema.field(n).type) for n, v in self.columns.items()}, schema=self.schema)
        self.columns, self.size = {n: [] for n in self.schema.names}, 0
        return made


_OUT = pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("value", pa.binary())])


def _save(rows: DataFrame, folder: str, separator: str) -> str:
    """One gzip file per archive, its records in order, each followed by ``separator``."""
    placed = rows.sortWithinPartitions("archive", "seq").select("archive", F.col("value").cast("string").alias("value"))
    made = placed.write.partitionBy("archive").option("lineSep", separator).option("compression", "gzip")
    made.option("zlib.compress.level", "BEST_SPEED").text(folder)
    return folder


def _files(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return found.select("path", "content")


def write_arc(pages: DataFrame, folder: str, archived: str = "20240101000000", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write ``page_id, url, html`` as ARC files, of version 1 and 2 by turns, in the order they are read."""

    def arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, rolled, seq, version = _Rows(_OUT), "", 0, 0, 0, 1
        for whole in batches:
            for batch in slices(whole, "html"):
                for part, page, url, html in zip(*(batch.column(n).to_pylist() for n in ("part", "page_id", "url", "html"))):
                    if not name or size >= archive_bytes:
                        name, version, size, seq = f"{part:06d}-{rolled:06d}", rolled % 2 + 1, 0, 0
                        rolled += 1
                        block = f"{version} 0 pages\n{' '.join(FIELDS[version])}\n"
                        middle = f" 200 - - 0 {name}.arc" if version == 2 else ""
                        out.add(200, name, seq, f"filedesc://{name}.arc 0.0.0.0 {archived} text/plain{middle} {len(block)}\n{block}".encode())
                    payload = (html or "").encode()
                    marked = "" if page is None else f"{PAGE_HEADER}: {page}\r\n"
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{marked}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                    target = quote((url or "").strip(), safe=_SAFE) or "-"
                    middle = f" 200 {sha1(payload)} - {size} {name}.arc" if version == 2 else ""
                    line = f"{target} 0.0.0.0 {archived} text/html{middle} {len(block)}\n".encode()
                    seq += 1
                    size += len(line) + len(block) + 1
                    out.add(len(line) + len(block), name, seq, line + block)
                    if out.full():
                        yield out.batch()
        yield out.batch()

    rows = pages.select(F.spark_partition_id().alias("part"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return _save(rows.mapInArrow(arc, "archive string, seq long, value binary"), folder, "\n")


def arc_index(spark: SparkSession, folder: str) -> DataFrame:
    """``path, offset, record_id, page_id, url, date, digest`` of the HTTP records of ARC files."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for offset, _, fields, block in arc_records(content.as_buffer().to_pybytes()):
                    parts = http_parts(block)
                    if parts is not None:
                        out.add(200, path, offset, record_id(path, offset), _page(parts[0]), fields["URL"], warc_date(fields["Archive-date"]), sha1(parts[2]))
                    if out.full():
                        yield out.batch()
        yield out.batch()

    return _files(spark, folder).mapInArrow(read, "path string, offset long, record_id string, page_id long, url string, date string, digest string")


def revisits(index: DataFrame) -> DataFrame:
    """``path`` and the ``revisits`` of that archive: offsets, and the response that each repeats."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset", "record_id", "url", "date")
    same = index.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
    same = written(same, "warc-same")
    later = salted_join(index.select("digest", "path", "offset"), same, ["digest"], key_counts=same, n_col="n").where("path <> first.path OR offset <> first.offset")
    # as many as one archive has records
    return later.groupBy("path").agg(F.collect_list(F.struct("offset", F.col("first.record_id").alias("id"), F.col("first.url").alias("url"), F.col("first.date").alias("date"))).alias("revisits"))


def warc_record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    head = ["WARC/1.0", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items() if v], f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block


def converted(path: str, content: bytes, repeats: dict[int, dict[str, str]]) -> Iterator[bytes]:
    """The WARC records of one ARC file."""
    info = None
    for offset, version, fields, block in arc_records(content):
        own, date = record_id(path, offset), warc_date(fields["Archive-date"])
        if fields["URL"].startswith("filedesc:"):
            info = own
            text = f"software: gridpanel\r\nformat: WARC File Format 1.0\r\ndescription: converted from ARC version {version}\r\n"
            name = fields["URL"].removeprefix("filedesc://")
            yield warc_record("warcinfo", {"WARC-Record-ID": own, "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, text.encode())
            continue
        target, ip = (None if fields[n] == "-" else fields[n] for n in ("URL", "IP-address"))
        named = {"WARC-Record-ID": own, "WARC-Warcinfo-ID": info, "WARC-Date": date, "WARC-Target-URI": target, "WARC-IP-Address": None if ip == "0.0.0.0" else ip}
        parts = http_parts(block)
        if parts is None:
            yield warc_record("resource", named | {"WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Type": fields["Content-type"]}, block)
            continue
        payload = {"WARC-Payload-Digest": f"sha1:{sha1(parts[2])}"}
        again = repeats.get(offset)
        if again is not None:
            payload |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": again["id"], "WARC-Refers-To-Target-URI": None if again["url"] == "-" else again["url"], "WARC-Refers-To-Date": again["date"]}
            block = parts[1]
        payload |= {"WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Type": "application/http; msgtype=response"}
        yield warc_record("response" if again is None else "revisit", named | payload, block)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str) -> str:
    """Write one WARC file for every ARC file of a folder."""
    decided = written(revisits(written(arc_index(spark, arc_folder), "warc-index")), "warc-revisits")
    if (decided.agg(F.sum(F.size("revisits"))).first()[0] or 0) <= BROADCAST_REVISITS:
        decided = F.broadcast(decided)  # else whole archives are dealt by path

    def warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_OUT)
        for batch in batches:
            for path, content, list_ in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("revisits")):
                repeats = {r["offset"]: r for r in list_.as_py() or ()}
                name = path.rsplit("archive=", 1)[-1].split("/")[0] if "archive=" in path else path.rsplit("/", 1)[-1]
                for seq, record in enumerate(converted(path, content.as_buffer().to_pybytes(), repeats)):
                    out.add(len(record), name, seq, record)
                    if out.full():
                        yield out.batch()
        yield out.batch()

    archives = _files(spark, arc_folder).join(decided, "path", "left")
    return _save(archives.mapInArrow(warc, "archive string, seq long, value binary"), warc_folder, "\r\n\r\n")


def warc_records(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case) and block of each record of a WARC file."""
    file = Unpacked(packed)
    while (line := file.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := file.line()) is not None and line.strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, file.run(int(fields["content-length"]))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, record_type, page_id, url, payload_bytes, payload_digest, refers_to_id`` of response and revisit records.

    A revisit's bytes are null, its digest is the declared one. Digests of responses are checked.
    """
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in warc_records(content.as_buffer().to_pybytes()):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = http_parts(block) or ({}, b"", block)
                    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), None
                    if kind == "response":
                        size = len(payload)
                        if sha1(payload) != digest:
                            raise ValueError(f"record {fields['warc-record-id']} does not have its digest")
                    out.add(200, fields["warc-record-id"], kind, _page(head), fields.get("warc-target-uri"), size, digest, fields.get("warc-refers-to"))
                    if out.full():
                        yield out.batch()
        yield out.batch()

    types = "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to_id string"
    return _files(spark, folder).mapInArrow(read, types)


def resolved(records: DataFrame) -> DataFrame:
    """:func:`read_warc` rows with ``refers_to`` (the response's ``page_id``), a revisit's bytes taken from its response."""
    records = written(records, "warc-records")
    again = records.where("record_type = 'revisit'")
    counts = again.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n"))
    first = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    joined = salted_join(again, first, ["refers_to_id"], "left", key_counts=written(counts, "warc-counts"), n_col="n")
    sound = F.col("_digest") == F.col("payload_digest")
    size = F.when(sound, F.col("_bytes")).otherwise(F.raise_error(F.lit("a revisit does not have the digest of its response")).cast("long"))
    told = joined.select(*[c for c in records.columns if c != "payload_bytes"], size.alias("payload_bytes"), "refers_to")
    return records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(told)


def through_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back; one row per page."""
    spark = pages.sparkSession
    arc = write_arc(pages, shared_folder(spark, "arc"), archive_bytes=archive_bytes)
    return resolved(read_warc(spark, convert(spark, arc, shared_folder(spark, "warc"))))
