"""Bodies of answers as text: content encodings undone, characters by header or meta tag."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
DECODED = "text string, charset string, error string"
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([^\s\"';,>]+)", re.I)
_META = re.compile(rb"<meta\b[^>]{0,500}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def _inflated(data: bytes, wbits: int, most: int) -> bytes:
    """All members of a stream, at most ``most`` bytes of output."""
    out, size = [], 0
    while data:
        z = zlib.decompressobj(wbits)
        part = z.decompress(data, most - size + 1)
        size += len(part)
        if size > most:
            raise ValueError("too large")
        if not z.eof:
            raise ValueError("cut off")
        out.append(part)
        data = z.unused_data if wbits == 31 and z.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


def undo(body: bytes, encoding: str, most: int = MOST_BYTES) -> bytes:
    """``body`` without its content encodings, the last one first: gzip, deflate in either framing, identity. Raises
    ValueError for unknown, broken, cut off or too large ones."""
    for name in reversed([e for e in re.split(r"[\s,]+", encoding.lower()) if e]):
        if name in ("gzip", "x-gzip"):
            tries = (31,)
        elif name == "deflate":
            tries = (15, -15)
        elif name == "identity":
            continue
        else:
            raise ValueError(f"unknown encoding {name}")
        for k, wbits in enumerate(tries):
            try:
                body = _inflated(body, wbits, most)
                break
            except zlib.error:
                if k == len(tries) - 1:
                    raise ValueError(f"broken {name}") from None
    return body


def charset_of(body: bytes, content_type: str) -> str:
    """By the header, else a meta tag in the first 2,048 bytes, else UTF-8; unknown names count as none."""
    meta = _META.search(body[:2048])
    for name in (m[1] if (m := _CHARSET.search(content_type)) else None, meta[1].decode("ascii") if meta else None):
        if name:
            try:
                b"x".decode(name)
                return name.lower()
            except (LookupError, UnicodeError):
                continue
    return "utf-8"


def _decoded(bodies: pd.Series, encodings: pd.Series, types: pd.Series) -> pd.DataFrame:
    rows = []
    for body, encoding, kind in zip(bodies, encodings, types):
        if body is None:
            rows.append((None, None, None))
            continue
        try:
            raw = undo(bytes(body), encoding or "")
            charset = charset_of(raw, kind or "")
            rows.append((raw.decode(charset, "replace"), charset, None))
        except ValueError as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["text", "charset", "error"])


def decoded(body: Column | str, encoding: Column | str, content_type: Column | str) -> Column:
    """struct<text, charset, error> of a body (binary) and two headers, which may be null. What a character set
    can't read is replaced; a body whose encoding is unknown, broken, cut off or too large is an error without a
    text. A null body gives nulls."""
    return F.pandas_udf(_decoded, DECODED)(body, encoding, content_type)
