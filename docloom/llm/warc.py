"""WARC derivatives: metadata and plain-text conversion records of responses."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import saved, table

DATE = "2024-01-01T00:00:00Z"
_RECORD = "id long, type string, record_id string, refers_to string, uri string, record binary"

# every pattern either takes what it has read or is tried once for it: time grows with the page
_DROP = re.compile(rb"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)", re.S | re.I)
_BREAK = re.compile(rb"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|nav|header|footer|title|blockquote|pre)\b[^>]*>", re.I)
_TAG = re.compile(rb"<[a-zA-Z/!?][^>]*>")
_TITLE, _END_TITLE = re.compile(rb"<title\b", re.I), re.compile(rb"</title\s*>", re.I)
_HTML, _LANG = re.compile(rb"<html\b", re.I), re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_A, _HREF = re.compile(rb"<a\b", re.I), re.compile(rb"\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same for the same parts, so a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; raises ValueError where it is not one."""
    end = record.find(b"\r\n\r\n")
    lines = record[:max(0, end)].decode("utf-8", "surrogatepass").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:  # a folded line goes on with the one before
            headers[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        headers[name] = value.strip()
    length = int(headers["content-length"])
    block = record[end + 4:end + 4 + length]
    if len(block) != length:
        raise ValueError("a WARC record is cut short")
    return headers, block


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [tuple(p.strip() for p in x.split(":", 1)) for x in lines[1:] if ":" in x], payload


def attributes(payload: bytes, tag: re.Pattern[bytes], attribute: re.Pattern[bytes]) -> Iterator[bytes]:
    """The values of an attribute in the tags that ``tag`` begins, in order.

    A tag reaches to the next ``>``. Where one has no such attribute, neither has a tag that
    begins inside it, so the search goes on behind it.
    """
    at = end = 0
    while begin := tag.search(payload, at):
        if begin.end() > end:
            end = payload.find(b">", begin.end())
            end = len(payload) if end < 0 else end
        found = attribute.search(payload, begin.end(), end)
        if found:
            yield found[1]
        at = found.end() if found else end


def page_title(payload: bytes) -> bytes | None:
    """What stands in the first title; where that has no end, no later one has."""
    begin = _TITLE.search(payload)
    inside = payload.find(b">", begin.end()) + 1 if begin else 0
    end = _END_TITLE.search(payload, inside) if inside else None
    return payload[inside:end.start()] if end else None


def charset(http: list[tuple[str, str]]) -> str:
    """The encoding that the HTTP headers name, UTF-8 where they name none that is known."""
    named = [m[1] for k, v in http if k.lower() == "content-type" and (m := _CHARSET.search(v))]
    try:
        b"a".decode(named[0], "replace")  # an empty text would not look the name up
        return named[0]
    except (LookupError, ValueError):  # no name, none that is known, or no encoding of text
        return "utf-8"


def plain_text(payload: bytes, encoding: str = "utf-8") -> str:
    """The text of an HTML page: scripts, styles, comments and tags gone, one line a block."""
    body = _DROP.sub(b" ", payload)
    upto = body.rfind(b">") + 1  # behind the last one no tag is closed
    body = _TAG.sub(b"", _BREAK.sub(b"\n", body[:upto])) + body[upto:]
    text = html.unescape(body.decode(encoding, "replace"))
    lines = (_BLANKS.sub(" ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def _clean(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def response_record(number: int | None, uri: str | None, page: str | None) -> tuple[str, bytes]:
    payload = (page or "").encode("utf-8", "surrogatepass")
    rid = record_id("response", str(number), uri or "", digest(payload))
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload
    return rid, write_record([
        ("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(uri)),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)),
        ("WARC-Payload-Digest", digest(payload))], block)


def derive(record: bytes) -> tuple[tuple[str, bytes], tuple[str, bytes]]:
    """((id, metadata record), (id, conversion record)) of a response record.

    Both refer to the response by its id and keep its URI and date. The metadata block lists
    the source's headers, size and digests, status, title, language and links; the conversion block
    is the page's plain text, in UTF-8 whatever the response's charset.
    """
    headers, block = read_record(record)
    status, http, payload = split_http(block)
    source = headers.get("warc-record-id", "")
    kept = [(n, headers[n.lower()]) for n in ("WARC-Target-URI", "WARC-Date") if n.lower() in headers]
    payload_digest = digest(payload)
    encoding = charset(http)
    text = plain_text(payload, encoding)
    title = page_title(payload)
    lang = next(attributes(payload, _HTML, _LANG), None)
    links = attributes(payload, _A, _HREF)
    conversion = text.encode("utf-8", "surrogatepass")
    cid, mid = record_id("conversion", source, payload_digest), record_id("metadata", source, payload_digest)
    fields = [("status", status), *((f"http-{k.lower()}", v) for k, v in http),
              ("source-block-digest", headers.get("warc-block-digest", digest(block))),
              ("source-payload-bytes", str(len(payload))),
              ("source-payload-digest", headers.get("warc-payload-digest", payload_digest)),
              ("payload-digest-valid", str(headers.get("warc-payload-digest", payload_digest) == payload_digest).lower()),
              ("conversion", cid)]
    if title is not None:
        fields.append(("title", _BLANKS.sub(" ", html.unescape(title.decode(encoding, "replace")).replace("\n", " ")).strip()))
    if lang:
        fields.append(("lang", lang.decode("latin-1")))
    fields += [("outlink", x.decode(encoding, "replace")) for x in links]
    facts_block = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    meta = write_record([
        ("WARC-Type", "metadata"), ("WARC-Record-ID", mid), ("WARC-Refers-To", source), *kept,
        ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(facts_block))], facts_block)
    conv = write_record([
        ("WARC-Type", "conversion"), ("WARC-Record-ID", cid), ("WARC-Refers-To", source), *kept,
        ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(conversion)),
        ("WARC-Payload-Digest", digest(conversion))], conversion)
    return (mid, meta), (cid, conv)


def responses(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, type, record_id, refers_to, uri, record): each page as a WARC response record.

    A null page has an empty payload, a null URI is empty; line breaks in a URI become spaces.
    Equal rows give equal records. Other columns are not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [response_record(i, u, h) for i, u, h in zip(batch["id"], batch["uri"], batch["page"])]
            yield pd.DataFrame({"id": batch["id"], "type": "response", "record_id": [m[0] for m in made],
                                "refers_to": None, "uri": batch["uri"], "record": [m[1] for m in made]})

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"),
                        F.col(html_col).cast("string").alias("page")).mapInPandas(run, _RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """Response records (id, record, ...) to their metadata and conversion records, same columns.

    Records of other types give nothing. A record that cannot be read raises: what is not a
    record should not pass as an empty page.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, record in zip(batch["id"], batch["record"]):
                headers, _ = read_record(record)
                if headers.get("warc-type") != "response":
                    continue
                meta, conv = derive(record)
                for kind, (rid, data) in (("metadata", meta), ("conversion", conv)):
                    out.append((i, kind, rid, headers.get("warc-record-id"), headers.get("warc-target-uri"), data))
            yield pd.DataFrame(out, columns=["id", "type", "record_id", "refers_to", "uri", "record"])

    return records.select("id", "record").mapInPandas(run, _RECORD)


def warc_bytes(records: list[bytes]) -> bytes:
    """A WARC file's content: each record a gzip member of its own, without a time stamp."""
    return b"".join(gzip.compress(r, 6, mtime=0) for r in records)


def _read_pair(n: int, meta: bytes, conv: bytes) -> dict:
    """What a metadata and a conversion record say of their response; raises where they do not agree."""
    (m, block), (c, text) = read_record(meta), read_record(conv)
    if m["warc-block-digest"] != digest(block) or c["warc-block-digest"] != digest(text):
        raise ValueError("the block of a WARC record does not have its digest")
    fields = [line.partition(": ")[::2] for line in block.decode("utf-8", "surrogatepass").split("\r\n") if line]
    one = dict(reversed(fields))
    if one["conversion"] != c["warc-record-id"] or m["warc-refers-to"] != c["warc-refers-to"]:
        raise ValueError("metadata and conversion record are not of one response")
    links = [v for k, v in fields if k == "outlink"]
    return {
        "url": m.get("warc-target-uri"), "response_id": m["warc-refers-to"], "metadata_id": m["warc-record-id"],
        "conversion_id": c["warc-record-id"], "metadata_refers_to": m["warc-refers-to"],
        "conversion_refers_to": c["warc-refers-to"], "payload_digest": one["source-payload-digest"],
        "text_digest": c["warc-payload-digest"], "payload_bytes": int(one["source-payload-bytes"]), "text_bytes": len(text),
        "n_links": len(links), "text": text.decode("utf-8", "replace"), "status": one["status"],
        "http_headers": [f"{k[5:]}: {v}" for k, v in fields if k.startswith("http-")], "title": one.get("title"),
        "lang": one.get("lang"), "outlinks": links, "source_block_digest": one["source-block-digest"],
        "payload_digest_valid": one["payload-digest-valid"] == "true", "n": n}


def summaries(records: DataFrame) -> DataFrame:
    """Metadata and conversion records, as of ``derivatives``, to one row a response: ids,
    digests, sizes, metadata fields, links and text, all read from the two records.

    The two meet by the response they refer to. Equal responses have equal records: they are
    read once and give a row each. A response without one of the two raises.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, n, k, meta, conv in zip(batch["page_id"], batch["n"], batch["n_conversions"], batch["metadata"], batch["conversion"]):
                if n != k:
                    raise ValueError("a response without its metadata or conversion record")
                rows.append({"page_id": i, **_read_pair(n, meta, conv)})
            yield pd.DataFrame(rows, columns=_SUMMARY_COLUMNS)

    def of(kind: str) -> Column:
        return F.when(F.col("type") == kind, F.col("record"))

    pairs = records.groupBy("refers_to").agg(
        F.first("id").alias("page_id"), F.count(of("metadata")).alias("n"), F.count(of("conversion")).alias("n_conversions"),
        F.first(of("metadata"), True).alias("metadata"), F.first(of("conversion"), True).alias("conversion"))
    return (pairs.drop("refers_to").mapInPandas(run, _SUMMARY)
            .withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n"))


_SUMMARY = ("page_id long, url string, response_id string, metadata_id string, conversion_id string, "
            "metadata_refers_to string, conversion_refers_to string, payload_digest string, text_digest string, "
            "payload_bytes long, text_bytes long, n_links long, text string, status string, http_headers array<string>, "
            "title string, lang string, outlinks array<string>, source_block_digest string, payload_digest_valid boolean, n long")
_SUMMARY_COLUMNS = [x.split()[0] for x in _SUMMARY.split(", ")]


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = saved(responses(table(spark, sf_dir, "pages")), "warc_responses", "zstd")
    return summaries(saved(derivatives(made), "warc_derivatives", "zstd"))


QUERIES = {"op9_warc_derivatives": op9_warc_derivatives}
