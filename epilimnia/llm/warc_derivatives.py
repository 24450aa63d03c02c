"""WARC derivatives: from each response record a metadata record and a plain-text conversion record that refer to it.

Records are rows: ``record_id, type, target_uri, date, refers_to, content_type, block`` and the digests of the block and of its
payload. Records that were read also have ``headers`` (their WARC header lines as they stand), ``raw`` (the block's bytes) and the
digests that they recorded; with ``raw``, lengths and digests are those of the bytes, and ``block`` is the text, its body decoded by
the charset of its content type. ``responses`` makes response records of fetched pages, ``derive`` the two derivatives of each, ``warc_text`` the
record as it stands in a WARC 1.1 file, ``write_warc`` and ``read_warc`` files of such records. Everything but parsing files is
column expressions: rows stay where they are, there is no shuffle.

A response's block is an HTTP message; its payload is what follows the first empty line. A derivative has its response's target
URI and date, ``WARC-Refers-To`` with the response's id, ``-Target-URI`` and ``-Date``, and in its own fields the source's content
type, length and digests, so the chain can be checked without the source. Its metadata block also has the response's WARC headers
(``source-warc-header``) and, line by line, the status line and headers of the HTTP message (``source-http-header``). These are
left out for a message whose head is just ``HTTP/1.1 200 OK``, the content type and the content length, as the other fields say it
all, which holds for those that ``responses`` makes. Ids are name-based and thus equal on every run.

Plain text is the payload of an HTML response without comments, scripts, styles and tags, with a line for each block element,
character references resolved once, and white space of a line made single. A tag ends at the first ``>`` outside of quoted
attribute values; if a quote never closes, at the first ``>`` of all. References are the names of HTML 4, ``&apos;`` and code
points; a no-break space becomes a space, a byte order mark nothing, a code that is no character U+FFFD, and unknown names stay.

Defined results: a NULL URL or body counts as empty; empty bodies give an empty conversion record, not none. Responses of another
content type than HTML or text get a metadata record only. Records of other types are left out. Repeated rows give repeated
records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilimnia.llm.common import read_table

CRLF = "\r\n"
#: The date of responses whose table has none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Lines end at these elements (fixed values), and these have no text.
BLOCK_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|p|pre|section|table|title|tr|ul"
DROPPED_TAGS = ("script", "style", "noscript", "template")
#: Comments and elements without text, in one pass: what begins first hides what begins within it.
NO_TEXT = "(?is)<(?:!--.*?-->|" + "|".join(rf"{tag}(?:\s[^>]*)?>.*?</{tag}\s*>" for tag in DROPPED_TAGS) + ")"
#: The rest of a tag behind its name, white space being spaces. The possessive forms keep Java from a recursion for each attribute; no
#: alternative begins like another, so the plain forms of other engines match alike.
TAG_REST = r"""(?:(?:[^>=]++|= *+(?:"[^"]*+"|'[^']*+'|[^ "'>]))*+(?:= *+)?+>|[^>]*+>)"""
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,7});"
CODES = {**name2codepoint, "apos": 39}
NO_BREAK_SPACE, BYTE_ORDER_MARK, NO_CHARACTER = 0xA0, 0xFEFF, 0xFFFD


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def record_id(*parts: Column) -> Column:
    """A name-based id from the MD5 of its parts."""
    h = F.md5(F.concat_ws("\n", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame) -> DataFrame:
    """A response record for each row of ``page_id, url, html``."""
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    length = F.octet_length(body).cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF))
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.md5(body)).alias("record_id"),
        F.lit("response").alias("type"),
        url.alias("target_uri"),
        F.lit(NO_DATE).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.concat(head, body).alias("block"),
    )


def http_payload(block: Column) -> Column:
    at = F.instr(block, CRLF + CRLF)
    return F.when(at > 0, F.substr(block, at + F.lit(4))).otherwise("")


def http_header(block: Column, name: str) -> Column:
    """A header's value from the message's head; empty without it."""
    head = F.substring_index(block, CRLF + CRLF, 1)
    return F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)


def raw_payload(raw: Column) -> Column:
    """The payload's bytes. ISO 8859-1 has a character for each byte, so places in it are places in the bytes."""
    return F.encode(http_payload(F.decode(raw, "ISO-8859-1")), "ISO-8859-1")


def header_fields(lines: Column, name: str) -> Column:
    """A field for each line of a head, NULL without any. A folded line stays with its own, a line of its field."""
    some = F.filter(F.split(lines, r"\r\n"), lambda x: x != "")
    return F.when(F.size(some) > 0, F.array_join(F.transform(some, lambda x: F.concat(F.lit(f"{name}: "), x)), CRLF))


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, NO_TEXT, "")
    text = F.regexp_replace(text, r"[\x09-\x0D]", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCK_TAGS})(?:>|[ /]{TAG_REST})", "\n")
    text = F.regexp_replace(text, rf"</?[a-zA-Z!]{TAG_REST}", "")
    # A lambda's variable is computed once, though it is used several times.
    text = F.element_at(F.transform(F.array(text), resolved), 1)
    text = F.regexp_replace(text, r"  +", " ")
    return F.trim(F.regexp_replace(text, r"\n[ \n]+| \n[ \n]*", "\n"), F.lit(" \n"))


def resolved(text: Column) -> Column:
    """The text with its character references replaced, each once: what they give is not looked at again."""
    parts = F.zip_with(
        F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), 0), lambda part, ref: F.concat(part, F.coalesce(character(ref), ref, F.lit("")))
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def character(reference: Column) -> Column:
    """The character that a reference stands for, NULL for unknown names."""
    name = F.substr(reference, F.lit(2), F.length(reference) - 2)
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair)), name)
    number = F.when(F.substr(name, F.lit(2), F.lit(1)).isin("x", "X"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
    code = F.when(reference.startswith("&#"), number.cast("int")).otherwise(named)
    # In four bytes a character is its code point.
    valid = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), code).otherwise(NO_CHARACTER)
    sign = F.decode(F.unhex(F.lpad(F.hex(valid), 8, "0")), "UTF-32")
    return F.when(code == NO_BREAK_SPACE, " ").when(code == BYTE_ORDER_MARK, "").when(code.isNotNull(), sign)


def derive(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Metadata and conversion records of the response records; ``carry`` names further columns to keep."""
    read = "raw" in records.columns
    whole = F.col("raw") if read else F.col("block")
    body = raw_payload(F.col("raw")) if read else http_payload(F.col("block"))
    source = records.where(F.col("type") == "response").select(
        *carry,
        F.col("record_id").alias("source_id"),
        "target_uri",
        "date",
        http_header(F.col("block"), "Content-Type").alias("source_type"),
        http_payload(F.col("block")).alias("payload"),
        F.substring_index("block", CRLF + CRLF, 1).alias("head"),
        (F.col("headers") if "headers" in records.columns else F.lit(None).cast("string")).alias("warc_head"),
        *((F.col(c) if c in records.columns else F.lit(None).cast("string")).alias(f"recorded_{c}") for c in ("block_digest", "payload_digest")),
        body.alias("body"),
        sha256(whole).alias("source_block"),
    )
    source = source.withColumn("source_payload", sha256(F.col("body"))).withColumn("source_length", F.octet_length("body"))
    length = F.col("source_length").cast("string")
    plain = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: "), "source_type", F.lit(f"{CRLF}Content-Length: "), length)
    is_text = F.col("source_type").rlike(r"(?i)^(text/|application/xhtml)")
    text = F.when(F.col("source_type").rlike(r"(?i)html"), plain_text(F.col("payload"))).otherwise(F.col("payload"))
    fields = F.concat_ws(
        CRLF,
        F.concat(F.lit("source-content-type: "), "source_type"),
        F.concat(F.lit("source-payload-length: "), F.col("source_length").cast("string")),
        F.concat(F.lit("source-payload-digest: "), "source_payload"),
        F.concat(F.lit("source-block-digest: "), "source_block"),
        F.concat(F.lit("source-recorded-block-digest: "), "recorded_block_digest"),
        F.concat(F.lit("source-recorded-payload-digest: "), "recorded_payload_digest"),
        header_fields(F.col("warc_head"), "source-warc-header"),
        F.when(F.col("head") != plain, header_fields(F.col("head"), "source-http-header")),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), F.concat(fields, F.lit(CRLF)).alias("block")),
        F.struct(F.when(is_text, "conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")),
    )
    rows = source.withColumn("made", F.explode(made)).where("made.type IS NOT NULL")
    return rows.select(
        *carry,
        record_id(F.col("made.type"), F.col("source_id")).alias("record_id"),
        F.col("made.type").alias("type"),
        "target_uri",
        "date",
        F.col("source_id").alias("refers_to"),
        F.col("made.content_type").alias("content_type"),
        F.octet_length("made.block").cast("long").alias("length"),
        sha256(F.col("made.block")).alias("block_digest"),
        F.col("source_payload").alias("source_payload_digest"),
        F.col("made.block").alias("block"),
    )


def warc_text(columns: list[str]) -> Column:
    """The record as in a file, without the two line ends that close it. A record that was read has its bytes and its headers."""
    read = "raw" in columns
    block = F.col("raw") if read else F.col("block")
    body = raw_payload(block) if read else http_payload(block)
    payload = F.when(F.col("type") == "response", sha256(body)).when(F.col("type") == "conversion", sha256(block))
    source = F.col("source_payload_digest") if "source_payload_digest" in columns else F.lit(None).cast("string")
    optional = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    derived = F.when(
        F.col("refers_to").isNotNull(),
        F.concat(line("WARC-Refers-To", F.col("refers_to")), line("WARC-Refers-To-Target-URI", F.col("target_uri")), line("WARC-Refers-To-Date", F.col("date"))),
    ).otherwise("")
    made = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Target-URI", F.regexp_replace("target_uri", r"[\r\n]", "")),
        line("WARC-Date", F.col("date")),
        derived,
        line("WARC-Block-Digest", sha256(block)),
        optional("WARC-Payload-Digest", payload),
        optional("WARC-Source-Payload-Digest", source),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    if "headers" in columns:
        made = F.coalesce(F.concat(F.lit(f"WARC/1.1{CRLF}"), F.col("headers")), made)
    # A cast of bytes to text leaves them as they are.
    return F.concat(made, F.lit(CRLF), block.cast("string"))


def write_warc(records: DataFrame, folder: str, compression: str = "none") -> None:
    """Files of whole records, ``gzip`` on demand. Spark's text sink closes each record with the two line ends that the format asks for."""
    if "refers_to" not in records.columns:
        records = records.withColumn("refers_to", F.lit(None).cast("string"))
    records.select(warc_text(records.columns).alias("value")).write.option("lineSep", CRLF + CRLF).text(folder, compression=compression)


READ_SCHEMA = (
    "record_id string, type string, target_uri string, date string, refers_to string, content_type string, block string, "
    "raw binary, headers string, block_digest string, payload_digest string, source_payload_digest string"
)
#: The header of each column that is one.
READ_HEADERS = {
    "record_id": "warc-record-id", "type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to",
    "content_type": "content-type", "block_digest": "warc-block-digest", "payload_digest": "warc-payload-digest",
    "source_payload_digest": "warc-source-payload-digest",
}


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of WARC files below ``folder``, plain or gzip; a file has to fit into a task, 2 GB at most. Raises on a damaged file.

    Members of a gzip file are unpacked one by one, each with whole records, as the format asks for.

    A file is damaged too if a block's bytes or a response's payload do not have the digest that the record states. Digests of
    unknown algorithms, and of payloads under a transfer encoding, about which tools differ, are kept but not compared.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    columns = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for part in _members(path, content):
                    yield pd.DataFrame(list(_records(path, part)), columns=columns)

    return files.mapInPandas(run, READ_SCHEMA)


def _members(path: str, content: bytes) -> Iterator[bytes]:
    """The members of a gzip file unpacked, or a plain file as it is."""
    if not content.startswith(b"\x1f\x8b"):
        yield content
        return
    rest = content
    while rest:
        member = zlib.decompressobj(zlib.MAX_WBITS | 16)
        try:
            part = member.decompress(rest)
        except zlib.error as error:
            raise ValueError(f"{path} holds a damaged gzip member") from error
        if not member.eof:
            raise ValueError(f"the last gzip member of {path} is cut")
        yield part
        rest = member.unused_data


def _records(path: str, content: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at} of {path}")
        lines = content[at:end].decode("utf-8").split(CRLF)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(head["content-length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} of {path} does not end where it says")
        raw = content[start:stop]
        http, gap, body = raw.partition(b"\r\n\r\n") if head.get("warc-type") == "response" else (b"", b"", raw)
        _compare(head.get("warc-block-digest"), raw, f"block of the record at byte {at} of {path}")
        if gap and not re.search(rb"(?im)^transfer-encoding:", http):
            _compare(head.get("warc-payload-digest"), body, f"payload of the record at byte {at} of {path}")
        typed = re.search(rb"(?im)^content-type:[^\r\n]*", http) if gap else None
        text = http.decode("utf-8", "replace") + gap.decode() + _decoded(body, typed[0].decode("latin-1") if typed else head.get("content-type", ""))
        named = {k: head.get(v) for k, v in READ_HEADERS.items()}
        yield (*(named[k] for k in list(READ_HEADERS)[:6]), text, raw, "".join(x + CRLF for x in lines), *(named[k] for k in list(READ_HEADERS)[6:]))
        at = stop + 4


def _compare(stated: str | None, data: bytes, what: str) -> None:
    """Raise if a digest in hexadecimal or base 32 is not that of the bytes."""
    name, _, value = (stated or "").partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return
    digest = hashlib.new(name, data).digest()
    if value.lower() != digest.hex() and value.upper().rstrip("=") != base64.b32encode(digest).decode().rstrip("="):
        raise ValueError(f"the {what} does not have its digest")


def _decoded(body: bytes, content_type: str) -> str:
    charset = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", content_type)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(read_table(spark, sf_dir, "pages")), carry=("page_id",))


def _sql() -> str:
    """The same records on DuckDB. Its expressions have no look at CRLF pairs, so the message is put together as above."""
    text = "payload"
    text = f"regexp_replace({text}, '{NO_TEXT}', '', 'g')"
    text = f"regexp_replace({text}, '[\\x09-\\x0D]', ' ', 'g')"
    rest = TAG_REST.replace("*+", "*").replace("++", "+").replace("?+", "?").replace("'", "''")
    text = f"regexp_replace({text}, '</?(?:{BLOCK_TAGS})(?:>|[ /]{rest})', chr(10), 'gi')"
    text = f"regexp_replace({text}, '</?[a-zA-Z!]{rest}', '', 'g')"
    names = ", ".join(f"'{name}': {code}" for name, code in CODES.items())
    code = f"""CASE WHEN r IS NULL THEN NULL WHEN r[1:3] IN ('&#x', '&#X') THEN CAST('0x' || r[4:-2] AS INTEGER)
      WHEN r[1:2] = '&#' THEN CAST(r[3:-2] AS INTEGER) ELSE MAP {{{names}}}[r[2:-2]] END"""
    sign = f"""CASE WHEN x.c IS NULL THEN x.r WHEN x.c = {NO_BREAK_SPACE} THEN ' ' WHEN x.c = {BYTE_ORDER_MARK} THEN ''
      WHEN x.c BETWEEN 1 AND 55295 OR x.c BETWEEN 57344 AND 1114111 THEN chr(x.c) ELSE chr({NO_CHARACTER}) END"""
    found = f"list_transform(regexp_extract_all(t, '{REFERENCE}'), lambda r: {{'r': r, 'c': {code}}})"
    signs = f"list_transform({found}, lambda x: {sign})"
    joined = f"array_to_string(list_transform(list_zip(string_split_regex(t, '{REFERENCE}'), {signs}), lambda y: y[1] || coalesce(y[2], '')), '')"
    text = f"list_transform([{text}], lambda t: {joined})[1]"
    text = f"regexp_replace({text}, ' +', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    uuid = lambda h: f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"
    return f"""
WITH crlf AS (SELECT chr(13) || chr(10) AS n),
source AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
         md5(concat_ws(chr(10), 'response', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''), md5(coalesce(html, '')))) AS h
  FROM pages),
message AS (
  SELECT *, {uuid("h")} AS source_id, 'sha256:' || sha256(payload) AS source_payload_digest,
         'sha256:' || sha256('HTTP/1.1 200 OK' || n || 'Content-Type: text/html; charset=utf-8' || n || 'Content-Length: '
           || strlen(payload) || n || n || payload) AS source_block
  FROM source, crlf),
made AS (
  SELECT *, 'metadata' AS type, 'application/warc-fields' AS content_type,
         'source-content-type: text/html; charset=utf-8' || n || 'source-payload-length: ' || strlen(payload) || n
           || 'source-payload-digest: ' || source_payload_digest || n || 'source-block-digest: ' || source_block || n AS block
  FROM message
  UNION ALL BY NAME
  SELECT *, 'conversion' AS type, 'text/plain; charset=utf-8' AS content_type, {text} AS block FROM message),
named AS (SELECT *, md5(concat_ws(chr(10), type, source_id)) AS g FROM made)
SELECT page_id, {uuid("g")} AS record_id, type, target_uri, '{NO_DATE}' AS date, source_id AS refers_to, content_type,
       strlen(block) AS length, 'sha256:' || sha256(block) AS block_digest, source_payload_digest, block
FROM named
"""


ORACLE = {"op5_warc_derivatives": _sql()}
