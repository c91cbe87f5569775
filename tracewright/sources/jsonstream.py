"""A streaming JSON reader: one pass over the text, no tree, no recursion.

:func:`events` is a generator over one text: it holds the open containers only.  A text must be one JSON value by
RFC 8259 as a whole before anything of it counts, so it is looked through first (:func:`soundness`), keeping nothing.
It is the common front of the shredding and the schema-drift operators.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

_W = r"[ \t\n\r]*+"
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_VALUE = re.compile(rf"{_W}(?:(?:{_STRING}|{_NUMBER}|true|false|null)|([\[{{]){_W}([\]}}]?))")
_KEY = re.compile(rf"{_W}{_STRING}{_W}:")
_MORE = {"{": re.compile(rf"{_W}(?:(\}})|,{_W}{_STRING}{_W}:)"), "[": re.compile(rf"{_W}(?:(\])|,)")}
_BLANK = re.compile(rf"{_W}\Z")
_INSIDE = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
#: A name, if there is one, and what follows: a string, an opening or a closing mark, or a bare word.  For sound texts only.
_TOKEN = re.compile(rf"[ \t\n\r,]*+(?:{_INSIDE}{_W}:{_W})?+(?:{_INSIDE}|([\[{{])|([\]}}])|([^ \t\n\r,:\[\]{{}}\"]++))")
_WORDS = {"true": "boolean", "false": "boolean", "null": "null"}

INVALID, SOUND, REPEATS = 0, 1, 2

#: (kind, name or None, text): kind is object, array, string, number, boolean or null, or ``end`` where a container closes.
Event = tuple[str, str | None, str | None]

_found: list[bool] = [False]


def _unnamed_twice(pairs: list) -> None:
    if len(dict(pairs)) != len(pairs):
        _found[0] = True


def _refuse(word: str) -> None:
    raise ValueError(word)


_DECODER = json.JSONDecoder(object_pairs_hook=_unnamed_twice, parse_int=float, parse_constant=_refuse)


def soundness(text: str | None) -> int:
    """``INVALID`` for null and what is not one JSON value; ``REPEATS`` if an object may hold a name twice; else ``SOUND``."""
    if text is None:
        return INVALID
    _found[0] = False
    try:
        _DECODER.decode(text)
    except RecursionError:  # too deep for the quick look
        return REPEATS if _follows_the_grammar(text) else INVALID
    except ValueError:
        return INVALID
    return REPEATS if _found[0] else SOUND


def _follows_the_grammar(text: str) -> bool:
    stack: list[str] = []
    pos = 0
    while True:
        m = _VALUE.match(text, pos)
        if m is None:
            return False
        pos = m.end()
        opened, closed = m.groups()
        if opened:
            if not closed:
                stack.append(opened)
                if opened == "{":
                    m = _KEY.match(text, pos)
                    if m is None:
                        return False
                    pos = m.end()
                continue
            if opened + closed not in ("{}", "[]"):
                return False
        while True:  # a value has ended
            if not stack:
                return _BLANK.match(text, pos) is not None
            m = _MORE[stack[-1]].match(text, pos)
            if m is None:
                return False
            pos = m.end()
            if not m.group(1):
                break
            stack.pop()


def events(text: str | None) -> Iterator[Event]:
    """The text's containers and scalars in document order.  Null or invalid text gives nothing.

    When a name occurs twice in an object, the last one holds; only such texts are held as a whole.
    """
    state = soundness(text)
    if state == INVALID:
        return iter(())
    return _stream(text) if state == SOUND else _last_of_each(_stream(text))


def _stream(text: str) -> Iterator[Event]:
    for m in _TOKEN.finditer(text):
        name, string, opened, closed, word = m.groups()
        if name is not None and "\\" in name:
            name = scanstring(f'"{name}"', 1, True)[0]
        if string is not None:
            yield "string", name, scanstring(f'"{string}"', 1, True)[0] if "\\" in string else string
        elif word is not None:
            yield _WORDS.get(word, "number"), name, word
        elif closed is not None:
            yield "end", None, None
        else:
            yield ("object" if opened == "{" else "array"), name, None


def _last_of_each(stream: Iterator[Event]) -> Iterator[Event]:
    """The events without those of members whose name occurs again in their object."""
    out: list[Event | None] = []
    names: list[dict[str, tuple[int, int]]] = [{}]
    opened: list[tuple[int, str | None]] = []
    for e in stream:
        kind, name, _ = e
        if kind == "end":
            names.pop()
            start, name = opened.pop()
            out.append(e)
            if name is not None:
                names[-1][name] = (start, len(out))
            continue
        if name is not None and name in names[-1]:
            a, b = names[-1][name]
            out[a:b] = [None] * (b - a)
        if kind in ("object", "array"):
            opened.append((len(out), name))
            names.append({})
        elif name is not None:
            names[-1][name] = (len(out), len(out) + 1)
        out.append(e)
    return (e for e in out if e is not None)
