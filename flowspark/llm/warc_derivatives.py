"""WARC derivatives: linked metadata and plain-text conversion records for response records.

No shuffle. ``read_warc`` reads the records of WARC files by their lengths in bytes, ``responses`` wraps a table of pages
as response records; ``derive`` gives each response a ``metadata`` record (its source's status and headers as they came,
digests and counts, as warc-fields) and a ``conversion`` record (its text), both with WARC-Refers-To the response and
digests of their own, in SQL functions. ``serialize`` and ``write_warc`` make WARC 1.1 files of any of these.

Derived records are UTF-8. A payload is decoded by the charset that its HTTP header, or else the page, names; its digest
and length are those of its bytes. Of entities, the five of XML and &nbsp; are decoded; others stay as they are.

Nulls: a null payload is an empty one, null http_headers leave their lines out; a null target URI or content type leaves that header out. Repeated rows give
repeated records with equal ids. Columns named in ``keep`` are carried. An empty table gives no records.
"""

from __future__ import annotations

import codecs
import gzip
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WARC_DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
BLOCK_TAGS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|blockquote|pre"
DROPPED = r"(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<!--.*?-->"
BREAKS = rf"(?i)</?(?:{BLOCK_TAGS})(?:[ \t\r\n/][^>]*)?>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
LINKS = r"(?i)<a[ \t\r\n][^>]*href="
TITLE = r"(?is)<title[^>]*>(.*?)</title"


def record_id(*parts: Column) -> Column:
    """A urn:uuid from a digest of ``parts``: the same response gives the same id wherever it is made."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block tags break lines, entities are decoded once."""
    t = F.regexp_replace(html, DROPPED, " ")
    t = F.regexp_replace(F.regexp_replace(t, BREAKS, "\n"), "<[^>]*>", "")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str = WARC_DATE, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        *keep,
        record_id(F.lit("response"), F.col("page_id"), F.col("url"), payload).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast("string").alias("refers_to"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.lit("text/html; charset=utf-8").alias("http_content_type"),
        head.alias("http_headers"),
        payload.alias("payload"),
        F.concat(head, F.lit(CRLF * 2), payload).alias("block"),
    ).withColumn("payload_digest", digest(F.col("payload"))).withColumn("block_digest", digest(F.col("block")))


def _header(head: str, name: str) -> str | None:
    found = re.search(rf"(?im)^{name}:[ \t]*([^\r\n]*)", head)
    return found[1].strip() or None if found else None


def _charset(content_type: str | None, payload: bytes) -> str:
    """The charset that the HTTP header names, else the page in its first KB, else UTF-8; unknown names count as UTF-8."""
    named = re.search(r"(?i)charset=[\"']?([\w.:-]+)", content_type or "") or re.search(r"(?i)<meta[^>]*charset=[\"']?([\w.:-]+)", payload[:1024].decode("latin-1"))
    try:
        return codecs.lookup(named[1]).name if named else "utf-8"
    except LookupError:
        return "utf-8"


def _as_text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_record(piece: bytes) -> tuple:
    """A row of ``RECORDS`` from a record's bytes after ``WARC/``."""
    head, gap, rest = piece.partition(b"\r\n\r\n")
    text = _as_text(head)
    stated = _header(text, "Content-Length")
    length = int(stated) if stated and stated.isdigit() else None
    block = rest if length is None else rest[:length]
    complete = bool(gap) and length is not None and len(rest) >= length
    kind, http, payload, charset = _header(text, "WARC-Type"), None, None, None
    if kind == "response" and b"\r\n\r\n" in block:
        own, _, payload = block.partition(b"\r\n\r\n")
        http = _as_text(own)
        charset = _charset(_header(http, "Content-Type"), payload)
    return (
        text.split("\r\n", 1)[0],
        *[kind if n == "WARC-Type" else _header(text, n) for n in _NAMES],
        block.decode("utf-8", "replace"),
        block,
        complete,
        http,
        http and _header(http, "Content-Type"),
        charset,
        None if payload is None else payload.decode(charset, "replace"),
        None if payload is None else len(payload),
        None if payload is None else f"sha256:{sha256(payload).hexdigest()}",
        f"sha256:{sha256(block).hexdigest()}",
    )


_NAMES = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type")
RECORDS = "version string, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block string, block_bytes binary, complete boolean, http_headers string, http_content_type string, charset string, payload string, payload_length long, payload_digest string, block_digest string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (``RECORDS``) of WARC 1.0 and 1.1 files, gzipped as a whole or a member a record, or not.

    A block has as many bytes as its header states, also where it holds a record of its own; ``block_bytes`` are these
    bytes, ``block`` the same as UTF-8 text. Of responses, also the status line and headers as they came, and the payload
    as text in its charset. What has no length, or fewer bytes than it states, comes with what there is and ``complete``
    false: count these rows; nothing is passed over. That also holds for a record with another one in it that a split of
    an uncompressed file cuts in two; gzipped files aren't split.
    """
    sep = b"\r\n\r\nWARC/1."
    raw = spark.read.option("lineSep", sep.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    columns = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = to_arrow_schema(StructType.fromDDL(RECORDS))

    def whole(piece: bytes) -> bool:
        head, gap, rest = piece.partition(b"\r\n\r\n")
        length = _header(_as_text(head), "Content-Length") if gap else None
        return not length or not length.isdigit() or len(rest) >= int(length)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source = None, None

        def rows(pieces: list[bytes]) -> pa.RecordBatch:
            got = list(zip(*map(parse_record, pieces), strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(got, kinds, strict=True)], columns)

        for batch in batches:
            done = []
            for value, file in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if file != source and held is not None:
                    done.append(held)
                    held = None
                if held is None:
                    held = value[7:] if value.startswith(b"WARC/1.") else value
                else:  # the separator stood inside a block
                    held += sep + value
                source = file
                if whole(held):
                    done.append(held)
                    held = None
            if done:
                yield rows(done)
        if held is not None:
            yield rows([held])

    return raw.mapInArrow(parse, RECORDS).withColumn("version", F.concat(F.lit("WARC/1."), "version"))


def derive(records: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A metadata and a conversion record for each response record; other records are passed over."""
    own = records.where("record_type = 'response'").withColumn("text", plain_text(F.col("payload")))
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(CRLF))).otherwise("")
    length = F.col("payload_length") if "payload_length" in records.columns else F.octet_length("payload")
    fields = F.concat(
        line("source-content-type", F.col("http_content_type")),
        line("source-content-length", length),
        line("source-payload-digest", F.col("payload_digest")),
        line("source-block-digest", F.col("block_digest")),
        F.when(F.col("http_headers").isNull(), "").otherwise(F.concat(F.lit("source-status: "), F.replace("http_headers", F.lit(CRLF), F.lit(f"{CRLF}source-header: ")), F.lit(CRLF))),
        line("title", F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[ \t\r\n]+", " ")),
        line("outlinks", F.regexp_count("payload", F.lit(LINKS))),
        line("text-digest", digest(F.col("text"))),
    )
    made = own.withColumn("fields", fields).select(
        *keep,
        "target_uri",
        "date",
        F.col("record_id").alias("refers_to"),
        F.explode(F.array(*[F.struct(F.lit(kind).alias("record_type"), record_id(F.lit(kind), F.col("record_id")).alias("record_id"), F.lit(mime).alias("content_type"), F.col(block).alias("block")) for kind, mime, block in (("metadata", "application/warc-fields", "fields"), ("conversion", "text/plain; charset=utf-8", "text"))])).alias("r"),
    )
    return made.select(*keep, "r.record_type", "r.record_id", "refers_to", "target_uri", "date", "r.content_type", F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), F.col("r.block").alias("block"))


def serialize(records: DataFrame) -> DataFrame:
    """Each record as one binary ``value`` of WARC headers and block, without the closing blank lines.

    The block is ``block_bytes`` where there are any, else ``block`` in UTF-8.
    """
    header = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF))).otherwise("")
    text = F.col("block").cast("binary")
    block = F.coalesce("block_bytes", text) if "block_bytes" in records.columns else text
    have = records.withColumn("_block", block).withColumn("content_length", F.octet_length("_block"))
    names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Length", "content_length"))
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[header(n, c) for n, c in names if c in have.columns], F.lit(CRLF))
    return have.select(F.concat(head.cast("binary"), F.col("_block")).alias("value"))


class _Writer(DataSourceArrowWriter):
    """WARC files, one for each task, whose names begin with ``_`` until the job is committed."""

    def __init__(self, path: str, compressed: bool):
        self.path, self.compressed, self.job = path, compressed, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, folder = FileSystem.from_uri(self.path)
        fs.create_dir(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}.warc" + (".gz" if self.compressed else "")
        with fs.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            for batch in iterator:
                for value in batch.column("value").to_pylist():
                    record = value + CRLF.encode() * 2
                    out.write(gzip.compress(record, 6, mtime=0) if self.compressed else record)
        return _Written(name)

    def commit(self, messages: list) -> None:
        self._end(messages, lambda fs, folder, name: fs.move(f"{folder}/_{name}", f"{folder}/{name}"))

    def abort(self, messages: list) -> None:
        self._end(messages, lambda fs, folder, name: fs.delete_file(f"{folder}/_{name}"))

    def _end(self, messages: list, act) -> None:
        from pyarrow.fs import FileSystem

        fs, folder = FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                act(fs, folder, m.name)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class WarcFiles(DataSource):
    """``records.write.format("warc")``: serialized records (``value``) as WARC files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "value binary"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("compression", "gzip") == "gzip")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files under ``path``, one for each partition; gzipped, each record is a member of its own and can be sought."""
    spark = records.sparkSession
    spark.dataSource.register(WarcFiles)
    serialize(records).write.format("warc").option("compression", compression).mode("append").save(path)


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``pages``."""
    text = f"regexp_replace(coalesce(html, ''), '{DROPPED}', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, char in ENTITIES:
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    text = rf"regexp_replace(regexp_replace(regexp_replace({text}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    crlf = "chr(13) || chr(10)"
    uuid = "'<urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12) || '>'"
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, {text} AS text FROM pages),
q AS (SELECT *, sha256('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '') || '|' || payload) AS h,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload)::VARCHAR || {crlf} || {crlf} || payload AS block FROM p),
r AS (SELECT *, {uuid.format('h')} AS rid FROM q),
f AS (SELECT *, 'source-content-type: text/html; charset=utf-8' || {crlf} || 'source-content-length: ' || strlen(payload)::VARCHAR || {crlf}
  || 'source-payload-digest: sha256:' || sha256(payload) || {crlf} || 'source-block-digest: sha256:' || sha256(block) || {crlf}
  || 'source-status: HTTP/1.1 200 OK' || {crlf} || 'source-header: Content-Type: text/html; charset=utf-8' || {crlf} || 'source-header: Content-Length: ' || strlen(payload)::VARCHAR || {crlf}
  || 'title: ' || regexp_replace(regexp_extract(payload, '{TITLE}', 1), '[ \\t\\r\\n]+', ' ', 'g') || {crlf}
  || 'outlinks: ' || len(regexp_extract_all(payload, '{LINKS}'))::VARCHAR || {crlf} || 'text-digest: sha256:' || sha256(text) || {crlf} AS fields FROM r),
d AS (SELECT page_id, 'metadata' AS record_type, sha256('metadata|' || rid) AS h, rid AS refers_to, url AS target_uri, 'application/warc-fields' AS content_type, fields AS block FROM f
  UNION ALL SELECT page_id, 'conversion', sha256('conversion|' || rid), rid, url, 'text/plain; charset=utf-8', text FROM f)
SELECT page_id, record_type, {uuid.format('h')} AS record_id, refers_to, target_uri, content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest FROM d
"""
