"""Links of a JSON document: its string values, neither cleaned nor filtered by scheme."""

from __future__ import annotations

import json

from strandweb.functions.urls import find_urls, looks_like_relative_path, resolve, strip_space


def json_links(text: str, base: str | None) -> list[str] | None:
    """Distinct links, sorted, or None if the text is no JSON. Keys, numbers and booleans hold no links.

    A value with absolute addresses gives those; another one gives itself if it looks like a path.
    """
    try:
        document = json.loads(text)
    except (ValueError, RecursionError):
        return None
    found: set[str] = set()
    waiting = [document]
    while waiting:
        value = waiting.pop()
        if isinstance(value, dict):
            waiting.extend(value.values())
        elif isinstance(value, list):
            waiting.extend(value)
        elif isinstance(value, str) and (value := strip_space(value)):
            raws = find_urls(value) or ([value] if looks_like_relative_path(value) else [])
            found.update(link for raw in raws if (link := resolve(raw, base)))
    return sorted(found)
