r"""A parsing expression grammar for several values packed in one text.

    text      <- array / list
    array     <- '[' JSON members ']' end
    list      <- item (sep item)* end
    item      <- blank* (quoted / bare)? blank*
    quoted    <- '"' ('""' / '\' any / !'"' any)* '"' &(blank* (sep / end))
               / '“' (!'”' any)* '”'                  &(blank* (sep / end))
    bare      <- (bracketed / !sep any)+
    bracketed <- '(' (bracketed / !')' any)* ')', and the same for '[' and '{'
    sep       <- [,;|，；、\t\r\n] / blank '/' &blank

Alternatives are ordered: an opening quote that has no end before a separator fails and the
parser backtracks to a bare value; so does an opening bracket that never closes.  Both leave
an error flag.  A text begun as an array that isn't valid JSON is read as a list, flagged.
"""

from __future__ import annotations

import json
import re

SEPARATORS = ",;|，；、\t\r\n"
_BLANK = re.compile(rf"[^\S{re.escape(SEPARATORS)}]*")
_SLASH = re.compile(r"(?<=\s)/(?=\s)")
_AFTER = re.compile(rf"[^\S{re.escape(SEPARATORS)}]*(?:[{re.escape(SEPARATORS)}]|/(?=\s)|\Z)")
_QUOTED = re.compile(r'"((?:""|\\.|[^"\\])*)"', re.S)
_CURLY = re.compile(r"“([^”]*)”", re.S)
_PLAIN = re.compile(rf"[^{re.escape(SEPARATORS)}/()\[\]{{}}]+")
_ESCAPE = re.compile(r'""|\\(.)', re.S)
_CLOSE = {"(": ")", "[": "]", "{": "}"}

BROKEN_ARRAY, BROKEN_QUOTE, BROKEN_BRACKET, NO_NAME = "broken_array", "broken_quote", "broken_bracket", "no_name"


def _bracketed(text: str, at: int) -> int | None:
    """Where the bracket opened at ``at`` has been closed, or None if it never is."""
    open_ = [_CLOSE[text[at]]]
    for i in range(at + 1, len(text)):
        ch = text[i]
        if ch == open_[-1]:
            open_.pop()
            if not open_:
                return i + 1
        elif ch in _CLOSE:
            open_.append(_CLOSE[ch])
        elif ch in "\r\n":
            return None
    return None


def _quoted(text: str, at: int) -> tuple[str, int] | None:
    for rule in (_QUOTED, _CURLY):
        m = rule.match(text, at)
        if m and _AFTER.match(text, m.end()):
            value = _ESCAPE.sub(lambda e: e.group(1) or '"', m.group(1)) if rule is _QUOTED else m.group(1)
            return value, m.end()
    return None


def _bare(text: str, at: int, flags: set[str]) -> int:
    n = len(text)
    while at < n:
        m = _PLAIN.match(text, at)
        if m:
            at = m.end()
            continue
        ch = text[at]
        if ch in _CLOSE:
            end = _bracketed(text, at)
            if end is None:
                flags.add(BROKEN_BRACKET)
            at = end or at + 1
        elif ch in ")]}" or (ch == "/" and not _SLASH.match(text, at)):
            at += 1
        else:
            break
    return at


def _list(text: str, flags: set[str]) -> list[str]:
    items, at, n = [], 0, len(text)
    while at <= n:
        at = _BLANK.match(text, at).end()
        value = None
        if at < n and text[at] in '"“':
            got = _quoted(text, at)
            if got:
                value, at = got
                at = _BLANK.match(text, at).end()
            else:
                flags.add(BROKEN_QUOTE)
        if value is None:
            end = _bare(text, at, flags)
            value, at = text[at:end], end
        value = value.strip()
        if value:
            items.append(value)
        at += 1  # the separator, or past the end
    return items


def split_packed(text: str | None) -> tuple[list[str], list[str]]:
    """(values in order, error flags).  Null, empty and blank texts have no value and no flag."""
    if text is None or not text.strip():
        return [], []
    flags: set[str] = set()
    if text.lstrip()[0] == "[":
        try:
            members = json.loads(text)
        except (ValueError, RecursionError):
            flags.add(BROKEN_ARRAY)
        else:
            items = []
            for m in members:
                value = m.get("name") if isinstance(m, dict) else m
                if isinstance(value, str):
                    if value.strip():
                        items.append(value.strip())
                elif isinstance(value, (int, float)) and not isinstance(value, bool):
                    items.append(json.dumps(value))
                elif value is not None or isinstance(m, dict):
                    flags.add(NO_NAME)
            return items, sorted(flags)
    return _list(text, flags), sorted(flags)
