"""Robots exclusion after RFC 9309: the longest matching pattern decides, and allow wins a tie."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import unquote_to_bytes

_SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%")
_agent = re.compile(r"^[A-Za-z_-]+")
_escape = re.compile(r"%[0-9A-Fa-f]{2}")


def _comparable(path: str) -> str:
    """Octets outside the URL characters escaped, escapes in upper case, those of unreserved characters undone."""
    text = "".join(chr(b) if b in _SAFE else f"%{b:02X}" for b in path.encode())

    def one(match: re.Match) -> str:
        octet = unquote_to_bytes(match.group())
        return octet.decode() if re.match(rb"[A-Za-z0-9\-._~]", octet) else match.group().upper()

    return _escape.sub(one, text)


def relevant_rules(body: str, agent: str) -> str:
    """The rules of one robots.txt that hold for one agent, a line for each: ``+`` or ``-`` and the pattern.

    Parsed once for each origin; what travels with its addresses are these lines, not the file.
    """
    token = match.group().lower() if (match := _agent.match(agent)) else agent.lower()
    own: list[str] = []
    general: list[str] = []
    found = False
    names: list[str] = []
    open_group = False  # several agent lines in a row share the rules that follow
    for line in body.lstrip("\ufeff").splitlines():
        field, mark, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not mark:
            continue
        if field == "user-agent":
            if not open_group:
                names, open_group = [], True
            match = _agent.match(value)
            names.append("*" if value.startswith("*") else match.group().lower() if match else "")
            found = found or token in names
        elif field in ("allow", "disallow"):
            open_group = False
            if not value:
                continue
            rule = ("+" if field == "allow" else "-") + _comparable(value)
            if token in names:
                own.append(rule)
            if "*" in names:
                general.append(rule)
    return "\n".join(own if found else general)


class Robots:
    """The rules that hold for an agent, ready to be asked."""

    def __init__(self, rules: str):
        lines = [(line[0] == "+", line[1:]) for line in rules.split("\n") if line]
        self.rules = [(len(pattern), allow, self._compiled(pattern)) for allow, pattern in lines]
        self.rules.sort(key=lambda r: (-r[0], not r[1]))

    @staticmethod
    def _compiled(pattern: str) -> re.Pattern:
        end = pattern.endswith("$")
        parts = (pattern[:-1] if end else pattern).split("*")
        return re.compile(".*".join(map(re.escape, parts)) + (r"\Z" if end else ""), re.DOTALL)

    def allows(self, path: str) -> bool:
        path = _comparable(path or "/")
        return next((allow for _, allow, pattern in self.rules if pattern.match(path)), True)


@lru_cache(maxsize=2048)
def _robots(rules: str) -> Robots:
    return Robots(rules)


def allowed_by(rules: str, url: str) -> bool:
    """Whether :func:`relevant_rules` allow ``url``, judged by its path and query. The robots file itself may always be read."""
    rest = url.split("#", 1)[0]
    match = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*(.*)$", rest, re.DOTALL)
    path = match.group(1) if match else rest
    if not path.startswith("/"):
        path = "/" + path
    return path == "/robots.txt" or _robots(rules).allows(path)


def allowed(body: str, agent: str, url: str) -> bool:
    """Whether ``agent`` may fetch ``url`` by a robots.txt."""
    return allowed_by(relevant_rules(body, agent), url)
