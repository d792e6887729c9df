"""Secret scan with recursive decoding.

Every text is a layer. A layer is scanned for three kinds of secret, then searched for encoded parts
(percent escapes, \\\\u escapes, base64; decoded bytes that start like gzip, zlib, bzip2 or Zstandard
data are unpacked, all members of them; base64 may be wrapped into lines), each of which is a new layer on the worklist, until none is left. A layer seen
before for the same part of the document is not opened again, so that data that decodes to itself
ends. A find in a decoded layer is reported at the span of the original text that it was decoded
from: escapes map character by character, base64 and compressed data as a whole.

Positions are code points, ends exclusive. Null text is empty text: no spans. A document's spans are
distinct and sorted by start, kind and end. Repeated rows are scanned one by one.

``MAX_UNPACKED`` bounds what one compressed part may unpack to, against decompression bombs; the
part before the bound is scanned, and ``n_cut`` counts parts that reached it, end early or have a
broken member behind the first.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Every 4th character of 32 hexadecimal ones.
_HEX_TRACE = re.compile(r"[0-9a-f]{8}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = re.compile(r"\r?\n[ \t]*")
_LAST_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]{1,15}={0,2})(?![A-Za-z0-9+/_=-])")
MAX_UNPACKED = 1 << 26


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that stand in a text as they are."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if _HEX_TRACE.search(text[::4]):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _as_text(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    bad = sum(1 for c in text if c < " " and c not in "\t\n\r\f\v")
    return text if bad * 20 <= len(text) else None


def _packing(head: bytes) -> str | None:
    """The kind of compressed data that begins like this."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return "zlib"
    if head[:3] == b"BZh":
        return "bzip2"
    return "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else None


def _decompressor(kind: str):
    if kind == "zstd":
        return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
    return bz2.BZ2Decompressor() if kind == "bzip2" else \
        zlib.decompressobj(31 if kind == "gzip" else 15)


def _unpack(data: bytes) -> tuple[bytes, bool] | None:
    """Unpacked data of all members that follow each other, and whether the bound, an early end or
    an error in a later member cut it; None for data that isn't compressed."""
    kind = _packing(data)
    if kind is None:
        return None
    # Zstandard takes no bound, so it gets little at a time.
    step = 64 if kind == "zstd" else 4096
    parts, size, at, cut = [], 0, 0, False
    while not cut and at < len(data) and _packing(data[at:at + 4]) == kind:
        first = at == 0
        try:
            d = _decompressor(kind)
            while not d.eof and at < len(data) and size < MAX_UNPACKED:
                piece = data[at:at + step]
                out = d.decompress(piece) if kind == "zstd" else \
                    d.decompress(piece, MAX_UNPACKED - size)
                parts.append(out)
                size += len(out)
                at += len(piece) - (len(d.unused_data) if d.eof else 0)
            cut = not d.eof or size >= MAX_UNPACKED
        except (zlib.error, OSError, EOFError, ValueError, zstandard.ZstdError):
            if first:
                return None
            cut = True
    return b"".join(parts)[:MAX_UNPACKED], cut


def _spread(text: str, pattern: re.Pattern, value) -> tuple[str, np.ndarray, np.ndarray]:
    """Replace single escapes; for each new character its start and end in the layer."""
    parts, starts, ends, last = [], [], [], 0
    for m in pattern.finditer(text):
        plain = text[last:m.start()]
        parts.append(plain)
        starts.append(np.arange(last, m.start()))
        ends.append(np.arange(last + 1, m.start() + 1))
        new = value(m)
        parts.append(new)
        starts.append(np.full(len(new), m.start()))
        ends.append(np.full(len(new), m.end()))
        last = m.end()
    parts.append(text[last:])
    starts.append(np.arange(last, len(text)))
    ends.append(np.arange(last + 1, len(text) + 1))
    return "".join(parts), np.concatenate(starts), np.concatenate(ends)


def _percent_text(m: re.Match) -> str:
    return bytes(int(x, 16) for x in _PERCENT.findall(m.group())).decode("utf-8", "replace")


def _unicode_text(m: re.Match) -> str:
    units = [int(x, 16) for x in _UNICODE.findall(m.group())]
    return b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "replace")


_UNICODE_CHARACTER = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}"
                              r"|\\u[0-9A-Fa-f]{4}")
_PERCENT_CHARACTER = re.compile(
    r"%[0-7][0-9A-Fa-f]|%[C-Dc-d][0-9A-Fa-f]%[89ABab][0-9A-Fa-f]"
    r"|%[Ee][0-9A-Fa-f](?:%[89ABab][0-9A-Fa-f]){2}|%[Ff][0-7](?:%[89ABab][0-9A-Fa-f]){3}"
    r"|%[0-9A-Fa-f]{2}")


def _whole(start: int, end: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, start), np.full(n, end)


def _tokens(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of base64 lines, and of the blocks of lines of one width that they
    make, with a last line that is shorter."""
    block: list[re.Match] = []

    def blocks() -> Iterator[tuple[int, int, str]]:
        whole = "".join(x.group() for x in block)
        start, end, width = block[0].start(), block[-1].end(), len(block[0].group())
        if len(block) > 1:
            yield start, end, whole
        last = _LAST_LINE.match(text, end)
        if last and len(block[-1].group()) == width and not whole.endswith("=") \
                and len(last[1]) < width:
            yield start, last.end(), whole + last[1]

    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), m.group()
        # A line that is shorter, or padded, ends its block.
        if block and not (_BREAK.fullmatch(text, block[-1].end(), m.start())
                          and len(block[-1].group()) == len(block[0].group()) >= len(m.group())
                          and not block[-1].group().endswith("=")):
            yield from blocks()
            block = []
        block.append(m)
    if block:
        yield from blocks()


def _layers(text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray, bool]]:
    """Decoded parts of a layer: text, start and end in the layer of each character, cut or not."""
    if "%" in text and _PERCENT.search(text):
        yield *_spread(text, _PERCENT_CHARACTER, _percent_text), False
    if "\\u" in text and _UNICODE.search(text):
        yield *_spread(text, _UNICODE_CHARACTER, _unicode_text), False
    for start, end, token in _tokens(text):
        token = token.rstrip("=").replace("-", "+").replace("_", "/")
        if len(token) % 4 == 1:
            continue
        try:
            data = base64.b64decode(token + "=" * (-len(token) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        cut = False
        opened: set[bytes] = set()
        while (unpacked := _unpack(data)) is not None:
            digest = hashlib.sha256(data).digest()
            if digest in opened:
                break
            opened.add(digest)
            data, was_cut = unpacked
            cut |= was_cut
        inner = data.decode("utf-8", "replace") if cut else _as_text(data)
        if inner:
            yield inner, *_whole(start, end, len(inner)), cut


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Spans (start, kind, end) of the text itself, those with all layers, and parts cut."""
    text = text or ""
    base = sorted(scan(text))
    every, cut = set(base), 0
    seen = {(text, 0, len(text))}
    work = [(text, None, None)]
    while work:
        layer, starts, ends = work.pop()
        for inner, at, to, was_cut in _layers(layer):
            cut += was_cut
            if starts is not None:
                at, to = starts[at], ends[to - 1]
            key = (inner, int(at[0]), int(to[-1]))
            if key in seen:
                continue
            seen.add(key)
            every.update((int(at[s]), kind, int(to[e - 1])) for s, kind, e in scan(inner))
            work.append((inner, at, to))
    return base, sorted(every), cut


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the struct ``secrets``: counts of each kind in the plain text, its spans
    and all spans as ``kind:start:end`` joined by commas, and the number of parts cut."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base string, spans string, n_cut long")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                base, every, cut = find(t)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), _joined(base), _joined(every),
                             cut))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "spans",
                                              "n_cut"])

    return documents.withColumn("secrets", found(F.col(text)))
