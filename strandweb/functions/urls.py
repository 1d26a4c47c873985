"""URL functions, as plain Python for use inside UDFs and as Column expressions where those are exact."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = "\t\n\v\f\r \x85\xa0  -     　"  # Unicode white space
_TRIM = f"^[{_SPACE}]+|[{_SPACE}]+$"
_trim = re.compile(_TRIM)
#: Absolute addresses inside a text; the white space is the ASCII one without the vertical tab.
URL_PATTERN = r"""https?://[^\t\n\f\r "'<>]+"""
_url = re.compile(URL_PATTERN)
_prefix = re.compile(r"^(https?://|/|\./|\.\./)", re.IGNORECASE)
_foreign = re.compile(r"^[^/?#]*:")
_trailing = re.compile(r"""[.,;:!?)\]}'"]+$""")
_scheme = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
_bad_escape = re.compile(r"%(?![0-9A-Fa-f]{2})")
_control = re.compile(r"[\x00-\x1f\x7f]")
_host = re.compile(r"""^(\[[^\]]*\]|[^:\s{}|\\^`%/?#@\[\]]*)(:[0-9]*)?$""")

_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~"
_PATH_KEPT = frozenset((_PLAIN + "$&+,/:;=@").encode())
_FRAGMENT_KEPT = frozenset((_PLAIN + "$&+,/:;=?@!()*").encode())
_QUERY_KEPT = frozenset(_PLAIN.encode())
_legal_path = re.compile(r"^(?:[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]]|%[0-9A-Fa-f]{2})*$")
_legal_fragment = re.compile(r"^(?:[A-Za-z0-9\-_.~$&+,/:;=?@!'()*\[\]]|%[0-9A-Fa-f]{2})*$")

#: Absolute addresses that are written as they would be.
_settled = re.compile(r"^https?://[A-Za-z0-9.\-]+(?::[0-9]+)?/[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]]*(?:\?[^#\x00-\x1f\x7f]+)?\Z")


def strip_space(text: str) -> str:
    """Without Unicode white space at both ends."""
    return _trim.sub("", text)


def _encode(raw: bytes, kept: frozenset[int]) -> str:
    return "".join(chr(b) if b in kept else f"%{b:02X}" for b in raw)


@dataclass(frozen=True)
class Address:
    """A parsed reference; ``path`` and ``fragment`` as they were written, ``opaque`` for addresses like ``mailto:x``."""

    scheme: str = ""
    opaque: str = ""
    authority: str | None = None
    path: str = ""
    query: str | None = None
    fragment: str = ""

    def __str__(self) -> str:
        head = f"{self.scheme}:" if self.scheme else ""
        if self.opaque:
            head += self.opaque
        else:
            path = self.path if _legal_path.match(self.path) else _encode(unquote_to_bytes(self.path), _PATH_KEPT)
            if self.authority is not None and (self.authority or self.path or not self.scheme):
                head += "//" + self.authority
                if path and not path.startswith("/") and self.authority:
                    head += "/"
            elif not head and ":" in path.split("/", 1)[0]:
                head = "./"
            head += path
        if self.query is not None:
            head += "?" + self.query
        if self.fragment:
            legal = _legal_fragment.match(self.fragment)
            head += "#" + (self.fragment if legal else _encode(unquote_to_bytes(self.fragment), _FRAGMENT_KEPT))
        return head


def parse(raw: str) -> Address | None:
    """The parts of a reference, or None where it can't be parsed: control characters, broken escapes, a bad host or port, or
    a colon in the first segment of a relative path."""
    if _control.search(raw):
        return None
    rest, _, fragment = raw.partition("#")
    if _bad_escape.search(fragment):
        return None
    scheme = ""
    if match := _scheme.match(rest):
        scheme, rest = match.group()[:-1].lower(), rest[match.end() :]
    elif rest.startswith(":"):
        return None
    rest, mark, query = rest.partition("?")
    given = query if mark else None
    if not rest.startswith("/"):
        if scheme:
            return Address(scheme, opaque=rest, query=given, fragment=fragment)
        if ":" in rest.split("/", 1)[0]:
            return None
    authority = None
    if rest.startswith("//") and (scheme or not rest.startswith("///")):
        authority, slash, path = rest[2:].partition("/")
        rest = slash + path
        user, at, host = authority.rpartition("@")
        if not _host.match(host) or (at and not re.fullmatch(r"(?:[A-Za-z0-9\-._:~!$&'()*+,;=@]|%[0-9A-Fa-f]{2})*", user)):
            return None
    if _bad_escape.search(rest):
        return None
    return Address(scheme, "", authority, rest, given, fragment)


def _without_dots(path: str) -> str:
    """RFC 3986, 5.2.4, for a path that begins with a slash or is empty."""
    kept: list[str] = []
    parts = path.split("/")
    for part in parts[1:] if path.startswith("/") else parts:
        if part == "..":
            if kept:
                kept.pop()
        elif part != ".":
            kept.append(part)
    if parts[-1] in (".", "..") and path:
        kept.append("")
    joined = "/" + "/".join(kept)
    return joined[1:] if joined.startswith("//") else joined


def _joined(base: Address, ref: Address) -> Address:
    if ref.authority is not None:
        return replace(ref, scheme=base.scheme, path=_without_dots(ref.path) if ref.path else "")
    if not ref.path:
        query = base.query if ref.query is None else ref.query
        kept = base.fragment if ref.query is None and not ref.fragment else ref.fragment
        if base.opaque:
            return replace(base, query=query, fragment=kept)
        return replace(base, path=_without_dots(base.path) if base.path else "", query=query, fragment=kept)
    full = ref.path if ref.path.startswith("/") else base.path.rpartition("/")[0] + "/" + ref.path
    return Address(base.scheme, "", base.authority, _without_dots(full), ref.query, ref.fragment)


@lru_cache(maxsize=4096)
def _base(base: str | None) -> Address | None:
    return parse(base) if base else None


def resolve(raw: str, base: str | None = None) -> str | None:
    """``raw`` resolved against ``base`` and written out, with ``/`` for an empty path; None if it can't be parsed.

    Absolute addresses keep their dot segments; relative ones without a usable base stay relative.
    """
    if _settled.match(raw):
        return raw
    address = parse(raw)
    if address is None:
        return None
    if not address.scheme and (known := _base(base)) is not None:
        address = _joined(known, address)
    return str(address if address.path or address.opaque else replace(address, path="/"))


def trim_trailing_punctuation(url: str) -> str:
    return _trailing.sub("", url)


def normalize(url: str) -> str:
    """A link as found in markup or script, cleaned; empty if it is none that can be crawled."""
    if url.startswith(("http://", "https://")) and "#" not in url and (url[-1] == "/" or url[-1].isalnum()):
        return url  # the usual case: nothing below would change it
    url = strip_space(strip_space(url).strip("\"'")).split("#", 1)[0]
    url = strip_space(url)
    if not url:
        return ""
    if url.startswith("//"):
        url = "http:" + url
    if not _prefix.match(url) and _foreign.match(url):
        return ""
    return strip_space(trim_trailing_punctuation(url))


def origin(url: str) -> str | None:
    """Scheme and authority (with user and port); None if the address can't be parsed. Opaque ones stay as they are."""
    address = parse(url)
    return None if address is None else str(replace(address, path="", query=None, fragment=""))


def correct_scheme(url: str) -> str:
    """With ``https://`` in front unless it is absolute with a host; as given where even that can't be parsed."""
    address = parse(url)
    if address is not None and address.scheme and address.authority:
        return url
    address = parse("https://" + url)
    return url if address is None else str(address)


def is_script_url(url: str) -> bool:
    return (url[:-1] if url.endswith("/") else url).endswith(".js")


def looks_like_relative_path(text: str) -> bool:
    """Whether a bare string is taken for a path: it has a slash, starts as a query or fragment, or has an inner dot."""
    if not text or text.startswith("data:") or any(c in text for c in ' \t\n"<>'):
        return False
    if text[0] in "/?#" or "/" in text:
        return True
    return 0 < text.rfind(".") < len(text) - 1


def srcset_candidates(value: str) -> list[str]:
    """First field of each comma-separated candidate."""
    fields = (part.split() for part in value.split(","))
    return [f[0] for f in fields if f]


def find_urls(text: str) -> list[str]:
    return _url.findall(text)


def screenshot_name(url: str) -> str:
    """File name of a page's screenshot: the query-escaped address."""
    return "".join("+" if b == 0x20 else chr(b) if b in _QUERY_KEPT else f"%{b:02X}" for b in url.encode()) + ".png"


# ---------------------------------------------------------------- Columns


def trimmed(text: Column) -> Column:
    """Like :func:`strip_space`; SQL ``trim`` only knows the blank."""
    return F.regexp_replace(text, _TRIM, "")


def normalize_column(url: Column) -> Column:
    """Like :func:`normalize`, without Python; null for a null."""
    bare = F.regexp_replace(trimmed(url), "^[\"']+|[\"']+$", "")
    bare = trimmed(F.substring_index(trimmed(bare), "#", 1))
    bare = F.regexp_replace(bare, "^//", "http://")
    foreign = ~bare.rlike(r"(?i)^(https?://|/|\./|\.\./)") & bare.rlike("^[^/?#]*:")
    return F.when(url.isNull(), None).when((bare == "") | foreign, "").otherwise(trimmed(F.regexp_replace(bare, r"""[.,;:!?)\]}'"]+$""", "")))


def looks_like_relative_path_column(text: Column) -> Column:
    barred = text.startswith("data:") | text.rlike('[ \\t\\n"<>]')
    dot = F.length(text) - F.locate(".", F.reverse(text)) + 1  # position of the last dot, from 1
    inner = text.contains(".") & (dot > 1) & (dot < F.length(text))
    return F.when((text == "") | barred, False).when(text.rlike("^[/?#]") | text.contains("/"), True).otherwise(inner)


def is_script_url_column(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "").endswith(".js")


def screenshot_name_column(url: Column) -> Column:
    """Java's form encoding differs from the one wanted in ``*`` and ``~``."""
    return F.concat(F.replace(F.replace(F.url_encode(url), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), F.lit(".png"))


def find_urls_column(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def origin_column(url: Column) -> Column:
    """Like :func:`origin` for hierarchical http(s) addresses, which is what a crawl holds; null for others."""
    found = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return F.when(found != "", F.concat(F.lower(F.substring_index(found, ":", 1)), F.regexp_extract(found, r"^[^:]*(:.*)$", 1)))
