"""Words and option texts of records, as the problems define them."""

from __future__ import annotations

import json
import re
import unicodedata

WORD = re.compile(r"[^\W_]+")
_PAIR = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*(?:"((?:[^"\\]|\\.)*)("?)|null|[^",}]*)', re.S)
_LABEL = re.compile(r"^\s*(?:[(\[]\s*(?:[A-Za-z]|\d{1,2})\s*[)\]]|(?:[A-Za-z]|\d{1,2})\s*[.):])(?=\s|$)\s*")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC and lower-casing; null has none."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.lower())


def _unescape(raw: str) -> str:
    while raw:
        try:
            return json.loads(f'"{raw}"', strict=False)
        except ValueError:
            cut = raw.rfind("\\")
            if cut < 0:
                return raw
            raw = raw[:cut]
    return ""


def _flat(value) -> list[str]:
    if value is None or isinstance(value, bool):
        return []
    if isinstance(value, dict):
        return [t for v in value.values() for t in _flat(v)]
    if isinstance(value, list):
        return [_LABEL.sub("", t) for v in value for t in _flat(v)]
    return [str(value)]


def option_texts(options: str | None) -> list[str]:
    """The texts of the options without their labels.

    A JSON object gives its values, a JSON list its items without labels; an object cut off in the middle gives the
    values read so far, the unfinished one included; anything else is read line by line, a leading ``A.``, ``A)``,
    ``(A)`` or ``A:`` being a label. Null options and null values give no text.
    """
    if not options:
        return []
    head = options.lstrip()
    if head[:1] in "{[":
        try:
            return _flat(json.loads(head, strict=False))
        except ValueError:
            pass
        if head[0] == "{":
            return [_unescape(m[2]) for m in _PAIR.finditer(head) if m[2] is not None]
    return [_LABEL.sub("", line) for line in options.splitlines()]


def record_words(question: str | None, options: str | None) -> list[str]:
    """All words of a record's question and option texts, repeats kept, in order."""
    out = words(question)
    for text in option_texts(options):
        out += words(text)
    return out
