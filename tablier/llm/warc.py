"""Operator 3: WARC derivatives - linked metadata and plain-text conversion records of responses.

A response record (HTTP header block and HTML payload) yields a ``metadata``
record with the source's HTTP headers, digests and outgoing-link count, and a
``conversion`` record with the plain text. Both carry ``WARC-Refers-To`` with
the response's record id, its target URI and date, and sha1 block and payload
digests. Record ids are name-based UUIDs of source id, kind and content, so a
retried task writes the same bytes. ``records`` gives the rows, ``gzip_members``
the file form: one gzip member per record, which concatenate to a valid file.

Null and empty HTML give an empty conversion; a null URL is an empty target
URI. Repeated rows give equal records. Rows without page_id are left out. Extra
columns are not read. A page is held whole by one task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRLF = b"\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: RFC 4122's URL name space
#: Date of records made from tables that carry none.
DATE = "2000-01-01T00:00:00Z"

# Every pattern reads on from where it stands: markup without an end is read once, whatever it holds.
_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|head)\b[^>]*+>?", re.I)
_END_OF = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "noscript", "template", "head", "title")}
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*+>?", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*+>?")
_ANCHOR = re.compile(r"<a\b([^>]*+)>?", re.I)
_HREF = re.compile(r"\bhref\s*+=", re.I)
_TITLE = re.compile(r"<title\b[^>]*+>", re.I)
_BLANKS = re.compile(r" {2,}")


def without_hidden(page: str) -> str:
    """The page with comments, scripts, styles, templates and head replaced by a blank.

    A comment, script or style without an end hides the rest; the other
    elements without an end are not hidden. Each end is sought at most once in
    vain, so the scan is linear.
    """
    out, at, endless = [], 0, set()
    while m := _HIDDEN.search(page, at):
        name = (m.group(1) or "").lower()
        end = None
        if not name:
            close = page.find("-->", m.end())
            end = close + 3 if close >= 0 else None
        elif name not in endless:
            close = _END_OF[name].search(page, m.end())
            end = close.end() if close else endless.add(name)
        if end is None and name not in ("", "script", "style"):
            out.append(page[at : m.end()])
            at = m.end()
            continue
        out += [page[at : m.start()], " "]
        if end is None:
            return "".join(out)
        at = end
    return "".join([*out, page[at:]])


def title_of(page: str) -> str | None:
    start = _TITLE.search(page)
    end = _END_OF["title"].search(page, start.end()) if start else None
    return page[start.end() : end.start()] if end else None


def links_in(page: str) -> int:
    return sum(bool(_HREF.search(m.group(1))) for m in _ANCHOR.finditer(page))


def plain_text(page: str) -> str:
    """Visible text, one line per block element, blanks folded."""
    body = _TAG.sub("", _BLOCK.sub("\n", without_hidden(page)))
    body = html.unescape(body)
    for blank in "\t\r\f\v\xa0":
        body = body.replace(blank, " ")
    lines = (x.strip(" ") for x in _BLANKS.sub(" ", body).split("\n"))
    return "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(source: object, kind: str, data: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{source}/{kind}/{hashlib.sha1(data).hexdigest()}')}>"


def record(kind: str, rid: str, uri: str, content_type: str, block: bytes, **more: str) -> bytes:
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": rid,
        "WARC-Date": more.pop("date", DATE),
        "WARC-Target-URI": uri,
        **{k.replace("_", "-"): v for k, v in more.items()},
        "WARC-Block-Digest": digest(block),
        "Content-Type": content_type,
        "Content-Length": str(len(block)),
    }
    lines = [b"WARC/1.1"] + [f"{k}: {' '.join(v.split())}".encode() for k, v in head.items()]
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def response(source: object, uri: str, page: str) -> bytes:
    """A response record as a crawler would store it."""
    payload = page.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode()
    block = http + CRLF + CRLF + payload
    return record("response", record_id(source, "response", block), uri, "application/http; msgtype=response", block, WARC_Payload_Digest=digest(payload))


def derive(data: bytes) -> tuple[bytes, bytes]:
    """The metadata and conversion records of a response record."""
    head, block = parse(data)
    http, _, payload = block.partition(CRLF + CRLF)
    page = payload.decode("utf-8", "replace")
    text = plain_text(page).encode("utf-8", "replace")
    rid, uri, date = head["WARC-Record-ID"], head.get("WARC-Target-URI", ""), head["WARC-Date"]
    source = http.decode("latin-1").split("\r\n")
    title = title_of(page)
    facts = [f"http-status: {source[0]}"] + [f"http-header: {x}" for x in source[1:]]
    facts += [
        f"payload-digest: {head.get('WARC-Payload-Digest') or digest(payload)}",
        f"payload-length: {len(payload)}",
        f"text-digest: {digest(text)}",
        f"text-length: {len(text)}",
        f"outlinks: {links_in(page)}",
        f"title: {' '.join(html.unescape(title).split()) if title else ''}",
    ]
    fields = ("\r\n".join(facts) + "\r\n").encode("utf-8", "replace")
    link = {"date": date, "WARC_Refers_To": rid, "WARC_Refers_To_Target_URI": uri, "WARC_Refers_To_Date": date}
    meta = record("metadata", record_id(rid, "metadata", fields), uri, "application/warc-fields", fields, **link)
    conv = record("conversion", record_id(rid, "conversion", text), uri, "text/plain; charset=utf-8", text, **link, WARC_Payload_Digest=digest(text))
    return meta, conv


def gzip_members(records: DataFrame) -> DataFrame:
    """``records`` with ``member``: the record as one reproducible gzip member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(member=[gzip.compress(bytes(x), 6, mtime=0) for x in pdf["record"]])

    return records.mapInPandas(run, T.StructType([*records.schema.fields, T.StructField("member", T.BinaryType())]))


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): response records of (page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [response(i, u, h) for i, u, h in zip(pdf["page_id"], pdf["url"], pdf["html"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "record": made})

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).where("page_id IS NOT NULL")
    return rows.mapInPandas(run, "page_id long, record binary")


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response: (page_id, warc_type, record_id, refers_to, target_uri, digests, lengths, text, record)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, data in zip(pdf["page_id"], pdf["record"]):
                for made in derive(bytes(data)):
                    head, block = parse(made)
                    rows.append(
                        (
                            page_id,
                            head["WARC-Type"],
                            head["WARC-Record-ID"],
                            head["WARC-Refers-To"],
                            head["WARC-Target-URI"],
                            head["WARC-Block-Digest"],
                            len(block),
                            block.decode("utf-8", "replace"),
                            made,
                        )
                    )
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return responses.mapInPandas(
        run,
        "page_id long, warc_type string, record_id string, refers_to string, target_uri string, block_digest string, "
        "block_length long, text string, record binary",
    )


_COLUMNS = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "block_length", "text", "record"]
