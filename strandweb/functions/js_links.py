"""Links of a script: constant strings that reach request calls, absolute addresses, and constants that look like paths.

Constants are propagated through declarations, assignments and object properties without regard to order or scope. The rounds
are bounded (one more than there are declarations and assignments, ``MOST_ROUNDS`` at most) and so is the length of a
constant; where assignments contradict each other the last one in the text wins. A script always ends.
"""

from __future__ import annotations

from strandweb.functions.js_syntax import Node, ScriptError, parse_script
from strandweb.functions.urls import find_urls, looks_like_relative_path, normalize, resolve, strip_space

MOST_ROUNDS, MOST_CHARACTERS = 64, 65_536
# Calls whose first argument is an address, and calls that take it from the ``url`` of an object literal.
FIRST_ARGUMENT_CALLS = ["fetch", "$.get", "$.getJSON", "$.post"]
OBJECT_CALLS = ["axios", "$.ajax", "jQuery.ajax"]
FIRST_ARGUMENT_PREFIX = "axios"
REQUEST_CLASS = "XMLHttpRequest"


class Constants:
    """What is known of names and of their properties."""

    def __init__(self) -> None:
        self.names: dict[str, str] = {}
        self.objects: dict[str, dict[str, str]] = {}

    def value(self, node: Node, known: dict[int, str | None] | None = None) -> str | None:
        """The constant text of an expression, or None."""
        if known is not None and id(node) in known:
            return known[id(node)]
        kind, out = node.kind, None
        if kind in ("str", "num"):
            out = node.value
        elif kind == "name":
            out = self.names.get(node.value)
        elif kind == "template":
            out = self._joined([x for i, text in enumerate(node.value) for x in ([text] if i == len(node.kids) else [text, node.kids[i]])], known)
        elif kind == "binary" and node.value == "+":
            parts, left = [], node
            while left.kind == "binary" and left.value == "+":  # a long sum leans to the left
                if known is not None and id(left) in known:
                    break
                parts.append(left.kids[1])
                left = left.kids[0]
            out = self._joined([left, *reversed(parts)], known)
        elif kind == "dot" and node.kids[0].kind == "name":
            out = self.objects.get(node.kids[0].value, {}).get(node.value)
        elif kind == "index" and node.kids[0].kind == "name" and node.kids[0].value in self.objects:
            if (key := self.value(node.kids[1], known)) is not None:
                out = self.objects[node.kids[0].value].get(key)
        if known is not None:
            known[id(node)] = out
        return out

    def _joined(self, parts: list, known: dict[int, str | None] | None) -> str | None:
        texts, length = [], 0
        for part in parts:
            text = part if isinstance(part, str) else self.value(part, known)
            if text is None or (length := length + len(text)) > MOST_CHARACTERS:
                return None
            texts.append(text)
        return "".join(texts)

    def _set(self, table: dict[str, str], key: str, value: str) -> bool:
        if table.get(key) == value:
            return False
        table[key] = value
        return True

    def _properties(self, name: str, literal: Node) -> bool:
        own, changed = self.objects.setdefault(name, {}), False
        for key, kid in zip(literal.value, literal.kids):
            if key is not None and (value := self.value(kid)) is not None:
                changed |= self._set(own, key, value)
        return changed

    def learn(self, declared: dict[str, Node], assigned: list[Node]) -> None:
        """Rounds over all declarations and assignments, until nothing changes or the bound is reached."""
        for _ in range(min(MOST_ROUNDS, len(declared) + len(assigned) + 1)):
            changed = False
            for name, start in declared.items():
                if start.kind == "object":
                    changed |= self._properties(name, start)
                elif name not in self.names and (value := self.value(start)) is not None:
                    changed |= self._set(self.names, name, value)
            for node in assigned:
                target, value = node.kids[0], self.value(node.kids[1])
                if value is None:
                    continue
                if target.kind == "name":
                    changed |= self._set(self.names, target.value, value)
                elif target.kids[0].kind == "name":
                    key = target.value if target.kind == "dot" else self.value(target.kids[1])
                    if key is not None:
                        changed |= self._set(self.objects.setdefault(target.kids[0].value, {}), key, value)
            if not changed:
                return


def _nodes(tree: Node) -> list[Node]:
    """All nodes, in the order of the text, without recursion."""
    found, waiting = [], [tree]
    while waiting:
        node = waiting.pop()
        found.append(node)
        waiting.extend(reversed(node.kids))
    return found


def _dotted(callee: Node) -> str:
    """``a.b.c`` of a callee; what isn't a name counts as empty."""
    parts: list[str] = []
    while callee.kind == "dot":
        parts.append(callee.value)
        callee = callee.kids[0]
    return ".".join([callee.value if callee.kind == "name" else "", *reversed(parts)])


def _is_request(node: Node) -> bool:
    return node.kind in ("new", "call") and node.kids[0].kind == "name" and node.kids[0].value == REQUEST_CLASS


def script_links(text: str, base: str | None) -> list[str] | None:
    """Distinct links, sorted, or None if the text is no script."""
    try:
        nodes = _nodes(parse_script(text))
    except ScriptError:
        return None
    declared = {n.value: n.kids[0] for n in nodes if n.kind == "declare" and n.value}
    assigned = [n for n in nodes if n.kind == "assign" and n.kids[0].kind in ("name", "dot", "index")]
    requests = {name for name, start in declared.items() if start.kind == "new" and _is_request(start)}
    requests |= {n.kids[0].value for n in assigned if n.kids[0].kind == "name" and n.kids[1].kind == "new" and _is_request(n.kids[1])}
    constants = Constants()
    constants.learn(declared, assigned)
    known: dict[int, str | None] = {}
    candidates: list[str | None] = list(find_urls(text))

    def argument(call: Node, position: int) -> None:
        if len(call.kids) > position + 1:
            candidates.append(constants.value(call.kids[position + 1], known))

    for call in nodes:
        if call.kind != "call":
            continue
        name = _dotted(call.kids[0])
        if name in OBJECT_CALLS:
            if len(call.kids) > 1 and call.kids[1].kind == "object":
                literal = call.kids[1]
                if "url" in literal.value:
                    candidates.append(constants.value(literal.kids[literal.value.index("url")], known))
        elif name in FIRST_ARGUMENT_CALLS or name.startswith(FIRST_ARGUMENT_PREFIX):
            argument(call, 0)
        elif name.endswith(".open"):
            receiver = call.kids[0].kids[0]
            if _is_request(receiver) or receiver.kind == "name" and receiver.value in requests:
                argument(call, 1)
    candidates += [v for n in nodes if (v := constants.value(n, known)) is not None and looks_like_relative_path(v)]
    found = set()
    for raw in candidates:
        if raw and strip_space(raw) and (clean := normalize(raw)) and (link := resolve(clean, base)):
            found.add(link)
    return sorted(found)
