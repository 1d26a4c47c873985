"""Content type of a body by its first bytes (the public MIME sniffing standard); the sender's header is ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 512
HTML, XML, PLAIN, BINARY = "text/html; charset=utf-8", "text/xml; charset=utf-8", "text/plain; charset=utf-8", "application/octet-stream"
# Tags that mark html, and the leading bytes of other types (with a mask where not all bytes count).
TAGS = ["<!DOCTYPE HTML", "<HTML", "<HEAD", "<SCRIPT", "<IFRAME", "<H1", "<DIV", "<FONT", "<TABLE", "<A", "<STYLE", "<TITLE", "<B", "<BODY", "<BR", "<P", "<!--"]
SIGNATURES = [
    (b"%PDF-", "application/pdf"),
    (b"%!PS-Adobe-", "application/postscript"),
    (b"\xfe\xff", "text/plain; charset=utf-16be"),
    (b"\xff\xfe", "text/plain; charset=utf-16le"),
    (b"\xef\xbb\xbf", "text/plain; charset=utf-8"),
    (b"\x00\x00\x01\x00", "image/x-icon"),
    (b"\x00\x00\x02\x00", "image/x-icon"),
    (b"BM", "image/bmp"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\x89PNG\x0d\x0a\x1a\x0a", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b".snd", "audio/basic"),
    (b"OggS\x00", "application/ogg"),
    (b"MThd\x00\x00\x00\x06", "audio/midi"),
    (b"ID3", "audio/mpeg"),
    (b"\x1a\x45\xdf\xa3", "video/webm"),
    (b"\x00\x01\x00\x00", "font/ttf"),
    (b"OTTO", "font/otf"),
    (b"ttcf", "font/collection"),
    (b"wOFF", "font/woff"),
    (b"wOF2", "font/woff2"),
    (b"\x1f\x8b\x08", "application/x-gzip"),
    (b"PK\x03\x04", "application/zip"),
    (b"Rar!\x1a\x07\x00", "application/x-rar-compressed"),
    (b"Rar!\x1a\x07\x01\x00", "application/x-rar-compressed"),
    (b"\x00asm", "application/wasm"),
]
RIFF = {b"WEBPVP": "image/webp", b"AVI ": "video/avi", b"WAVE": "audio/wave"}


def _mp4(head: bytes) -> bool:
    if len(head) < 12 or head[4:8] != b"ftyp":
        return False
    size = int.from_bytes(head[:4], "big")
    if size % 4 or len(head) < size:
        return False
    return any(head[i : i + 3] == b"mp4" for i in range(8, size, 4) if i != 12)


def content_type(body: bytes) -> str:
    """The sniffed type; of an empty body, that of unknown bytes."""
    head = body[:HEAD]
    if not head:
        return BINARY
    bare = head.lstrip(b"\t\n\x0c\r ")
    upper = bare.upper()
    for tag in TAGS:
        mark = tag.encode()
        if upper.startswith(mark) and (tag == "<!--" or bare[len(mark) : len(mark) + 1] in (b" ", b">")):
            return HTML
    if bare.startswith(b"<?xml"):
        return XML
    for mark, kind in SIGNATURES:
        if head.startswith(mark):
            return kind
    if head[:4] == b"RIFF":
        for mark, kind in RIFF.items():
            if head[8 : 8 + len(mark)] == mark:
                return kind
    if head[:4] == b"FORM" and head[8:12] == b"AIFF":
        return "audio/aiff"
    if len(head) > 36 and head[34:36] == b"LP":
        return "application/vnd.ms-fontobject"
    if _mp4(head):
        return "video/mp4"
    if any(b < 9 or b == 0x0B or 0x0E <= b <= 0x1A or 0x1C <= b <= 0x1F for b in bare):
        return BINARY
    return PLAIN


def content_type_column(body: Column) -> Column:
    """:func:`content_type` of bodies held as text, which are sniffed as UTF-8."""
    head = F.substring(body, 1, HEAD)
    bare = F.regexp_replace(head, "^[\\t\\n\\f\\r ]+", "")
    raw = F.substring(F.encode(head, "UTF-8"), 1, HEAD)
    at = lambda begin, mark: F.substring(raw, begin + 1, len(mark)) == F.lit(bytearray(mark))
    tags = "|".join(t.replace("!", r"\!") for t in TAGS if t != "<!--")
    kind = F.when(body.isNull() | (body == ""), BINARY).when(bare.rlike(rf"(?i)^(?:(?:{tags})[ >]|<!--)"), HTML).when(bare.startswith("<?xml"), XML)
    for mark, name in SIGNATURES:
        kind = kind.when(at(0, mark), name)
    for mark, name in RIFF.items():
        kind = kind.when(at(0, b"RIFF") & at(8, mark), name)
    kind = kind.when(at(0, b"FORM") & at(8, b"AIFF"), "audio/aiff").when((F.length(raw) > 36) & at(34, b"LP"), "application/vnd.ms-fontobject")
    size = F.conv(F.hex(F.substring(raw, 1, 4)), 16, 10).cast("long")
    brands = F.sequence(F.lit(8), F.greatest(F.lit(8), F.least(size, F.lit(HEAD)).cast("int") - 1), F.lit(4))
    mp4 = F.exists(brands, lambda i: (i != 12) & (F.substr(raw, i + 1, F.lit(3)) == F.lit(bytearray(b"mp4"))))
    kind = kind.when(at(4, b"ftyp") & (F.length(raw) >= 12) & (size % 4 == 0) & (F.length(raw) >= size) & mp4, "video/mp4")
    return kind.when(bare.rlike(r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]"), BINARY).otherwise(PLAIN)
