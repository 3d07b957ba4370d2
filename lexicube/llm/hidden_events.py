"""Sentence boundaries as hidden events between words.

A text is cut into segments where a boundary is certain (empty lines, separator
tags). Between any two words of a segment a boundary token may be hidden; an n-gram
model gives P(event | left) and P(right | event), and the events of a segment form a
chain, as a boundary right after another is unlikely. Forward-backward gives the
posterior of every event.

Texts come in two kinds. In *marked* ones sentences end with marks, so the context to the
left of an event is the mark with the word before it (the word before a period, the word
before a number, or how a quotation that ends here was led in) and the symbol to the right
is a word, character, digit or opening quote. Without a mark P(event | left) is that of
headings, so low that no right symbol can lift the posterior to one half (``UNMARKED``);
only places with marks are written down as *gaps*. In *plain* texts, which have no
sentence mark at all, every gap between words counts, in scripts without spaces every gap
between characters, and the words themselves are the contexts (:func:`plain_odds`).

The model needs no labels: segment ends are certain boundaries, words inside clauses
are certain non-boundaries, and the gaps themselves are re-estimated by expectation
maximisation over the whole collection. What it finds in marked texts, without the marks,
is what the n-grams of plain ones are counted from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

TAG = "story_separator_special_tag"
_TERM = re.compile("[.!?…。！？｡．।॥؟۔]+")
_HARD = re.compile(rf"{TAG}|\n[^\S\n]*\n\s*")
_WORD_LEFT = re.compile(r"[^\s\"“”«»„‘()\[\]「」『』（）—]*$")
_WORD = re.compile(r"[\w’'-]+")
_OPEN = {"“": "”", "„": "“", "«": "»", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》"}
_THAI = re.compile("[ก-๛]")
_THAI_GAP = re.compile("[ \t 　]+")
_NO_CASE = re.compile("[֐-෿฀-࿿぀-ヿ㐀-鿿가-힯]")
_CJK = re.compile("[฀-໿぀-ヿ㐀-鿿]")


#: Bounds of the logarithm of P(right | boundary) / P(right | none), and the prior logit of a
#: boundary without a mark in a marked text: together below 0.
RATIO = (-8.0, 5.0)
UNMARKED = -7.0


@dataclass
class Gap:
    at: int  # the sentence would end here
    left: str
    right: str
    words: int = 0  # words since the gap before
    sure: bool = False
    next: int = 0  # the next sentence would start here


def left_class(left: str) -> str:
    """What a rare left context is counted as."""
    kind, _, word = left.partition(":")
    if kind == "w":
        if "." in word:
            return "W:dotted"
        if len(word) == 1:
            return "W:one"
        shape = "U" if word[:1].isupper() else "l" if word[:1].islower() else "o"
        return f"W:{shape}{'s' if len(word) <= 3 else ''}"
    return "#" if kind == "#" else left


def right_class(right: str) -> str:
    """What a rare right symbol is counted as."""
    if right.startswith("w:"):
        c = right[2:3]
        return "w*U" if c.isupper() else "w*l" if c.islower() else "w*o"
    return "c*" if right.startswith("c:") else right


def segments(text: str) -> list[tuple[int, int]]:
    """Stretches between certain boundaries, without outer white space."""
    out, at = [], 0
    for m in [*_HARD.finditer(text), None]:
        end = m.start() if m else len(text)
        a, b = _trim(text, at, end)
        if a < b:
            out.append((a, b))
        at = m.end() if m else end
    return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[a].isspace() or text[a] in "﻿​"):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in "﻿​"):
        b -= 1
    return a, b


def pairs(s: str) -> dict[int, int]:
    """Closing position -> opening position of quotes and brackets that do match."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for i, ch in enumerate(s):
        if ch.isalnum() or ch == " ":
            continue
        if ch == '"':
            known = [j for j, (c, _) in enumerate(stack) if c == '"']
            if known:
                out[i] = stack[known[-1]][1]
                del stack[known[-1] :]
            else:
                stack.append(('"', i))
            continue
        if any(c == ch for c, _ in stack) and not (ch == "’" and i + 1 < len(s) and s[i + 1].isalnum()):
            j = max(j for j, (c, _) in enumerate(stack) if c == ch)
            out[i] = stack[j][1]
            del stack[j:]
        elif ch in _OPEN:
            stack.append((_OPEN[ch], i))
    return out


def right_symbol(s: str, at: int) -> str:
    """The symbol that starts at ``at``."""
    ch = s[at]
    if ch.isdigit():
        return "#"
    if ch.isalpha():
        if _CJK.match(ch):
            return "c:" + ch
        m = _WORD.match(s, at)
        return "w:" + (m[0] if m else ch)
    return "Q" if ch in '"“„«‘「『' else "(" if ch in "(（[" else "p:" + ch


def _intro(s: str, opening: int, terminal_ends: set[int]) -> str:
    """How the quotation or bracket that opens here is led in."""
    i = opening
    while i > 0 and s[i - 1].isspace():
        i -= 1
    kind = "p" if s[opening] in "(（[" else "q"
    if i == 0 or i in terminal_ends:
        return kind + "start"
    return kind + ("colon" if s[i - 1] in ":：" else "comma" if s[i - 1] in ",，、" else "mid")


def gaps(s: str) -> list[Gap]:
    """All gaps of a segment, the last one (its end) included as a sure boundary."""
    close = pairs(s)
    depth = [0] * (len(s) + 1)
    for c, o in close.items():
        depth[o + 1] += 1
        depth[min(c + 1, len(s))] -= 1
    for i in range(1, len(s) + 1):
        depth[i] += depth[i - 1]
    # depth[i] counts the pairs that are open in front of position i
    out: list[Gap] = []
    ends: set[int] = set()
    thai = bool(_THAI.search(s))
    if thai:
        for m in _THAI_GAP.finditer(s):
            if 0 < m.start() and m.end() < len(s) and not s[m.start() - 1].isdigit() and not s[m.end()].isdigit() and "\n" not in (s[m.start() - 1], s[m.end()]):
                out.append(Gap(m.start(), "thai", "thai", 9, True, m.end()))
    seen = 0
    for m in _TERM.finditer(s):
        mark, g, opening = m[0], m.end(), None
        while g < len(s):
            if g in close:
                opening = close[g]
                g += 1
            elif s[g] in "   " and g + 1 < len(s) and s[g + 1] == "»" and g + 1 in close:
                opening = close[g + 1]
                g += 2
            else:
                break
        if opening is not None and opening >= m.start():
            opening = None
        if depth[g] > 0 if g < len(s) else False:
            continue
        if g < m.end():
            continue
        rest = g
        while rest < len(s) and s[rest].isspace():
            rest += 1
        left = _left(s, m.start(), mark, opening, ends)
        if rest == len(s):
            out.append(Gap(len(s), left, "end", 0, True, len(s)))
            break
        if rest == g and not _may_be_glued(s, m.start(), g, mark, opening):
            continue
        ends.add(g)
        out.append(Gap(g, left, right_symbol(s, rest), max(1, len(s[seen:g].split()) if not _CJK.search(s[seen:g]) else (g - seen) // 3), False, rest))
        seen = g
    else:
        out.append(Gap(len(s), "none", "end", 0, True, len(s)))
    return sorted(out, key=lambda x: x.at)


def _left(s: str, at: int, mark: str, opening: int | None, ends: set[int]) -> str:
    if opening is not None:
        return f"{_intro(s, opening, ends)}:{mark[-1]}"
    if mark != ".":
        spaced = "_" if at == 0 or s[at - 1].isspace() else ""
        return f"m:{spaced}{''.join(sorted(set(mark))) + ('*' if len(mark) > 1 and len(set(mark)) == 1 else '')}"
    word = _WORD_LEFT.search(s[max(0, at - 40) : at])[0].lstrip("'’¿¡")
    if word[-1:].isdigit():
        before = s[max(0, at - 80) : at - len(word)].split()
        return "#:" + (before[-1] if before else "")
    return "w:" + word


def _may_be_glued(s: str, at: int, g: int, mark: str, opening: int | None) -> bool:
    """Whether a boundary is possible where no white space follows."""
    nxt, prev = s[g], s[at - 1] if at else " "
    if nxt in ",;:，；、：)-–/'’%":
        return False
    if mark != "." or opening is not None:
        return not (set(mark) <= {"."} and nxt.islower())
    if nxt.isdigit():
        return prev.isalpha() and prev.islower() and bool(re.search(r"[^\W\d_]{3,}$", s[max(0, at - 20) : at]))
    if nxt.isalpha():
        if nxt.islower():
            return False
        if _NO_CASE.match(nxt):
            return bool(re.search(r"\w{3,}$", s[max(0, at - 20) : at]))
        return True
    return nxt in '"“„«‘「『(（¿¡'


def observe(s: str, found: list[Gap], count: Counter) -> None:
    """Count what a segment shows: (kind, left, right) with kind gap, end, start or mid."""
    count["start", "", right_symbol(s, 0)] += 1
    for g in found:
        if g.right == "end":
            count["end", g.left, ""] += 1
        elif not g.sure:
            count["gap", g.left, g.right] += 1
    prev_open = False
    for m in _NONSPACE.finditer(s):
        if m.start() and not prev_open:
            count["mid", "", right_symbol(s, m.start())] += 1
        prev_open = bool(_TERM.search(m[0][-3:]))
    if _CJK.search(s):
        for i in range(1, len(s)):
            if _CJK.match(s[i]) and s[i - 1].isalnum():
                count["mid", "", "c:" + s[i]] += 1


_NONSPACE = re.compile(r"\S+")
_PLAIN = re.compile("[\u0e80-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\ufa00-\ufaff]|[^\\W_]+(?:['’-][^\\W_]+)*")


def is_plain(text: str) -> bool:
    """A text without any sentence mark, in a script in which spaces don't end sentences by rule."""
    return not _TERM.search(text) and not _THAI.search(text)


def plain_tokens(s: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their places; characters where a script has no spaces."""
    return [(m[0].lower(), m.start(), m.end()) for m in _PLAIN.finditer(s)]


#: Weight of a boundary behind a boundary after 1, 2 or more words.
CLOSE = {1: 0.05, 2: 0.4}


def decide(odds: list[float], after: list[float]) -> list[bool]:
    """Whether the posterior of each event is one half or more, by forward-backward.

    ``odds`` are logits of the events by themselves, ``after`` the weight of a boundary
    there if the event before is one.
    """
    yes = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    f: list[tuple[float, float]] = []  # forward: weights of none and of a boundary
    for y, w in zip(yes, after):
        n0, b0 = f[-1] if f else (0.0, 1.0)
        none, bound = (n0 + b0) * (1 - y), (n0 + b0 * w) * y
        z = none + bound or 1.0
        f.append((none / z, bound / z))
    back, out = (1.0, 1.0), []
    for i in range(len(yes) - 1, -1, -1):
        out.append(f[i][1] * back[1] >= f[i][0] * back[0])
        x0, x1 = (1 - yes[i]) * back[0], yes[i] * back[1]
        b0, b1 = x0 + x1, x0 + x1 * after[i]
        z = b0 + b1 or 1.0
        back = (b0 / z, b1 / z)
    return out[::-1]


def decide_plain(odds: list[float]) -> list[bool]:
    """As :func:`decide` for the gaps between all words, where the event before is a word away.

    A state remembers how many words ago the last boundary was, up to three.
    """
    n = len(odds)
    yes = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    weight = [CLOSE.get(k + 1, 1.0) for k in range(3)]
    f = [[0.0, 0.0, 0.0]]
    f[0][0] = 1.0  # states before gap 0: one word since the start
    for y in yes:
        a = f[-1]
        bound = y * sum(x * w for x, w in zip(a, weight))
        row = [bound, a[0] * (1 - y), (a[1] + a[2]) * (1 - y)]
        z = sum(row) or 1.0
        f.append([x / z for x in row])
    back, out = [1.0, 1.0, 1.0], []
    for i in range(n - 1, -1, -1):
        post = [x * b for x, b in zip(f[i + 1], back)]
        out.append(post[0] >= 0.5 * (sum(post) or 1.0))
        y = yes[i]
        back = [y * weight[k] * back[0] + (1 - y) * back[min(k + 1, 2)] for k in range(3)]
        z = max(back) or 1.0
        back = [x / z for x in back]
    return out[::-1]
