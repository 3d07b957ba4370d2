"""Error-recovering recursive descent over embedding files.

Grammar (white space is space, tab and CR; outer white space is ignored)::

    file   := line (NL line)*
    line   := header | record
    header := digits digits
    record := key value{dim}
    field  := '"' text '"' | text          text has no quote and no white space

Each rule reports located errors and goes on: a bad field never hides the next
one. When a quote is left open, the rest of its line can't be trusted; the file
rule then resumes at the next *validated record start*: a line start from which a
key and a first value really parse. What is skipped is reported, never lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Reasons, the first that holds is reported.
REASONS = ("encoding", "quoting", "field_count", "doc_id", "value")
FLOAT32_MAX = float(np.finfo(np.float32).max)
LONG_MAX = 2**63 - 1

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_FIELD = re.compile(r"[^ \t\r]+")
_VALUE = re.compile(_NUMBER)
_DIGITS = re.compile(r"[0-9]+")
_BAD_CHAR = re.compile("[�\x00]")
_ANCHOR = re.compile(r'(?:^|(?<=\n))[ \t\r]*(?="?[^" \t\r\n]+"?[ \t\r]+"?' + _NUMBER + r'"?(?:[ \t\r\n]|$))')


@dataclass
class Outcome:
    """What one line gave: ``kind`` is ``record``, ``header`` or ``error``."""

    kind: str
    key: object = None
    vector: np.ndarray | None = None
    reason: str | None = None
    position: int | None = None
    field_no: int | None = None
    start: int = 0
    end: int = 0


class RecordGrammar:
    """``dim`` numbers behind a key; ``long_key``: the key must be a signed 64-bit integer."""

    def __init__(self, dim: int = 100, long_key: bool = True):
        self.dim, self.long_key = dim, long_key
        key = "[0-9]{1,18}" if long_key else '[^" \\t\\r\x00�]+'
        self._good = re.compile(rf"[ \t\r]*({key})((?:[ \t\r]+{_NUMBER}){{{dim}}})[ \t\r]*")

    # line := header | record
    def line(self, text: str | None, base: int = 0) -> Outcome:
        """Parse one line; null counts as an empty line (no fields)."""
        text = text or ""
        if m := self._good.fullmatch(text):  # the whole record in one match: most lines
            vector = np.array(m[2].split(), dtype=np.float64)
            if np.abs(vector).max() <= FLOAT32_MAX:
                return Outcome("record", int(m[1]) if self.long_key else m[1], vector.astype(np.float32), start=base, end=base + len(text))
        fields = [(m.start(), m[0]) for m in _FIELD.finditer(text)]
        if len(fields) == 2 and all(_DIGITS.fullmatch(f) for _, f in fields):
            return Outcome("header", start=base, end=base + len(text))
        errors: dict[str, tuple[int, int | None]] = {}

        def note(reason: str, at: int, no: int | None) -> None:
            errors.setdefault(reason, (base + at, no))

        if m := _BAD_CHAR.search(text):
            note("encoding", m.start(), None)
        if len(fields) != self.dim + 1:
            note("field_count", fields[-1][0] if fields else 0, len(fields))
        key, values = None, []
        for no, (at, raw) in enumerate(fields):
            bare = self._field(raw, at, no, note)
            if no == 0:
                key = self._key(bare, at, note)
            else:
                values.append(self._value(bare, at, no, note))
        for reason in REASONS:
            if reason in errors:
                at, no = errors[reason]
                return Outcome("error", reason=reason, position=at, field_no=no, start=base, end=base + len(text))
        return Outcome("record", key, np.array(values, dtype=np.float64).astype(np.float32), start=base, end=base + len(text))

    # field := '"' text '"' | text
    def _field(self, raw: str, at: int, no: int, note) -> str:
        if '"' not in raw:
            return raw
        if len(raw) >= 2 and raw[0] == raw[-1] == '"' and '"' not in raw[1:-1]:
            return raw[1:-1]
        note("quoting", at + raw.index('"'), no)
        return raw.strip('"')

    def _key(self, bare: str, at: int, note) -> object:
        if not self.long_key:
            return bare
        if not _DIGITS.fullmatch(bare) or int(bare) > LONG_MAX:
            note("doc_id", at, 0)
            return None
        return int(bare)

    def _value(self, bare: str, at: int, no: int, note) -> float:
        if not _VALUE.fullmatch(bare) or abs(float(bare)) > FLOAT32_MAX:
            note("value", at, no)
            return 0.0
        return float(bare)

    def event(self, text: str | None) -> int | None:
        """What a line does to recovery: 1 an odd number of quotes opens one, 0 a validated record start, None neither."""
        text = text or ""
        if text.count('"') % 2:
            return 1
        return 0 if _ANCHOR.match(text) else None

    # file := line (NL line)*
    def file(self, text: str) -> Iterator[Outcome]:
        """Parse a whole text; quoted fields may hold line breaks in a broken file.

        An open quote swallows line ends until some later quote. So a line with an
        odd number of quotes is an error, and the parse resumes at the next
        validated record start, skipping (and reporting) what lies between.
        """
        at = 0
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            out = self.line(text[at:end], at)
            yield out
            nxt = end + 1
            if text.count('"', at, end) % 2:
                m = _ANCHOR.search(text, nxt)
                resume = m.start() if m else len(text)
                if text[nxt:resume].strip(" \t\r\n"):
                    yield Outcome("error", reason="quoting", position=nxt, start=nxt, end=resume)
                nxt = resume
            at = nxt
