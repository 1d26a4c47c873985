"""Links of an HTML document."""

from __future__ import annotations

from html.parser import HTMLParser

from strandweb.functions.js_links import script_links
from strandweb.functions.urls import find_urls, normalize, resolve, srcset_candidates, strip_space

# The attributes that hold addresses, of any element.
ADDRESS_ATTRIBUTES = ["href", "src", "srcset", "data-src", "data-srcset", "data-href", "action", "formaction", "poster", "cite", "background", "manifest", "longdesc", "ping", "data", "codebase", "archive", "dynsrc", "lowsrc"]
_ATTRIBUTES = frozenset(ADDRESS_ATTRIBUTES)
_CANDIDATE_LISTS = frozenset(("srcset", "data-srcset"))
#: Elements whose content is text to an HTML parser (with scripting on), whatever it looks like.
_RAW = frozenset(("noscript", "textarea", "title", "style", "iframe", "xmp", "noembed", "noframes"))
# Types of scripts, and ends of such types.
SCRIPT_TYPES = ["", "module"]
SCRIPT_TYPE_ENDS = ["javascript", "ecmascript"]


def is_script_type(kind: str | None) -> bool:
    """Parameters after a semicolon belong to the type, so a type that has any is none."""
    plain = strip_space((kind or "").lower())
    return plain in SCRIPT_TYPES or plain.endswith(tuple(SCRIPT_TYPE_ENDS))


class _Collector(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.addresses: list[str] = []
        self.scripts: list[str] = []
        self._raw: str | None = None
        self._script: list[str] | None = None

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if self._raw:
            return
        for name, value in attributes:
            if value and name in _ATTRIBUTES:
                self.addresses.extend(srcset_candidates(value) if name in _CANDIDATE_LISTS else [value])
        if tag == "script":
            given: dict[str, str | None] = {}
            for name, value in attributes:
                given.setdefault(name, value)
            if is_script_type(given.get("type")) and not given.get("src"):
                self._script = []
        elif tag in _RAW:
            self._raw = tag

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)  # a slash before the end of a tag closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == self._raw:
            self._raw = None
        if tag == "script" and self._script is not None:
            text = "".join(self._script)
            if strip_space(text):
                self.scripts.append(text)
            self._script = None

    def handle_data(self, data: str) -> None:
        if self._script is not None:
            self._script.append(data)

    def close(self) -> None:
        super().close()
        self.handle_endtag("script")  # one that the document's end cuts off


def html_links(body: str, base: str | None) -> list[str]:
    """Distinct links, sorted: of attributes, candidate lists, inline scripts, and of absolute addresses anywhere in the raw text."""
    collector = _Collector()
    try:
        collector.feed(body)
        collector.close()
    except (AssertionError, ValueError, RecursionError):
        pass  # what was read so far counts
    found: set[str] = set()
    for raw in {*collector.addresses, *find_urls(body)}:
        if (clean := normalize(raw)) and (link := resolve(clean, base)):
            found.add(link)
    for script in collector.scripts:
        found.update(script_links(script, base) or ())
    return sorted(found)
