"""Blocks of a markdown file, line by line: a stack of containers (quotes, list items) with one open leaf at its end.

Every line first goes on with the containers that it fits, then may open new ones, then belongs to a leaf. A paragraph may turn
into a heading by the line below it, a fence ends by as many signs of its own, and an item of a tight list has no paragraph.
"""

from __future__ import annotations

import re
from typing import NamedTuple

SECTION, CODE, PARAGRAPH = 0, 1, 2

_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"(?:=+|-+)[ \t]*$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
_DEFINITION = re.compile(r" {0,3}\[(?:\\.|[^\[\]\\])+\]:[ \t]*(?:<[^<>]*>|\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
# How a block of raw markup starts, what ends it (blank: a blank line), and whether it may follow a paragraph.
_MARKUP = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (
        re.compile(
            r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|"
            r"footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|"
            r"section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)",
            re.I,
        ),
        None,
        True,
    ),
    (re.compile(r"(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$"), None, False),
)
#: Containers that may be open at once.
DEEPEST = 100


class Block(NamedTuple):
    node_type: int
    start: int
    end: int
    line_start: int
    line_end: int
    heading: str | None


class _List:
    def __init__(self, kind: str):
        self.kind, self.loose = kind, False


class _Container:
    """A quote, or an item of a list whose content is indented by so much."""

    def __init__(self, indent: int = 0, of: _List | None = None):
        self.indent, self.of, self.empty = indent, of, True


def plain(text: str) -> str:
    """The text of a heading: no code, no signs of emphasis, of links their text."""
    text = re.sub(r"(?<!`)(`+)(?!`)(?:.*?[^`])??\1(?!`)", "", text)
    text = re.sub(r"!?\[([^\[\]]*)\]\([^()]*\)", r"\1", text)
    text = re.sub(r"(?<![\\\w])(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", text)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text).strip()


def _indent(line: str, at: int, column: int) -> tuple[int, int]:
    """Columns of white space from a place on, and the place behind it."""
    k, c = at, column
    while k < len(line) and line[k] in " \t":
        c = c + 4 - c % 4 if line[k] == "\t" else c + 1
        k += 1
    return c - column, k


class _Reader:
    def __init__(self):
        self.found: list[tuple[Block, _List | None]] = []
        self.headings: list[tuple[int, int, str]] = []
        self.stack: list[_Container] = []
        self.leaf: str | None = None
        self.blank_before = False

    def open_leaf(self, kind: str, start: int, line: int, **more) -> None:
        top = self.stack[-1] if self.stack else None
        if top is not None and top.of is not None and self.blank_before and not top.empty:
            top.of.loose = True
        for c in self.stack:
            c.empty = False
        self.leaf, self.start, self.line_start = kind, start, line
        self.depth, self.more = len(self.stack), more

    def grow(self, end: int, line: int) -> None:
        self.end, self.line_end = end, line

    def close_leaf(self) -> None:
        kind, self.leaf = self.leaf, None
        if kind == "paragraph":
            first = next((k for k, (text, *_) in enumerate(self.texts) if not _DEFINITION.match(text)), None)
            if first is None:
                return
            _, start, line = self.texts[first]
            own = self.stack[self.depth - 1].of if self.depth and self.depth <= len(self.stack) else None
            self.found.append((Block(PARAGRAPH, start, self.end, line, self.line_end, None), own))
        elif kind in ("fence", "indented"):
            language = (self.more.get("info") or "").strip() or None
            self.found.append((Block(CODE, self.start, self.end, self.line_start, self.line_end, language), None))

    def heading(self, start: int, line: int, text: str) -> None:
        for c in self.stack:
            c.empty = False
        self.headings.append((start, line, plain(text)))

    def cut_stack(self, n: int) -> None:
        if self.leaf is not None and self.depth > n:
            self.close_leaf()
        del self.stack[n:]

    def line(self, line: str, start: int, number: int) -> None:
        at, column, matched = 0, 0, 0
        for c in self.stack:
            width, k = _indent(line, at, column)
            if c.of is None:
                if width > 3 or line[k : k + 1] != ">":
                    break
                at, column = k + 1, column + width + 1
                if line[at : at + 1] in (" ", "\t"):
                    # of a tab only one column belongs to the sign
                    at, column = (at + 1, column + 1) if line[at] == " " or column % 4 == 3 else (at, column)
            elif k == len(line) and not c.empty or width >= c.indent:
                take = min(width, c.indent)
                while take > 0 and at < len(line):
                    step = 4 - column % 4 if line[at] == "\t" else 1
                    if step > take:
                        break
                    at, column, take = at + 1, column + step, take - step
            else:
                break
            matched += 1
        end = start + len(line)
        width, k = _indent(line, at, column)
        rest, blank = line[k:], k == len(line)
        whole = matched == len(self.stack)
        if self.leaf in ("fence", "markup") and self.depth > matched:
            self.close_leaf()
        if self.leaf == "fence":
            self.grow(end, number)
            sign = self.more["sign"]
            if width <= 3 and len(rest.rstrip(" \t")) >= len(sign) and not rest.rstrip(" \t").strip(sign[0]):
                self.close_leaf()
            return
        if self.leaf == "markup":
            if self.more["until"] is None and blank:
                self.leaf = None
            elif self.more["until"] is not None and self.more["until"].search(rest):
                self.leaf = None
            self.blank_before = blank
            return
        if blank:
            if self.leaf == "paragraph":
                self.close_leaf()
            if not whole and (matched == 0 or self.stack[matched].of is None):
                self.cut_stack(matched)
            self.blank_before = True
            return
        if self.leaf == "indented" and whole and width >= 4:
            self.grow(end, number)
            self.blank_before = False
            return
        if self.leaf == "indented":
            self.close_leaf()
        opened = matched
        while True:
            paragraph = self.leaf == "paragraph" and opened == len(self.stack) == self.depth
            lazy = self.leaf == "paragraph"
            if width >= 4 and not lazy:
                self.cut_stack(opened)
                self.open_leaf("indented", start + at, number)
                self.grow(end, number)
                break
            if width >= 4:
                self.text(start + k, end, number, rest, opened, lazy)
                break
            if rest[0] == ">" and len(self.stack) < DEEPEST:
                self.cut_stack(opened)
                if self.leaf == "paragraph":
                    self.close_leaf()
                self.stack.append(_Container())
                opened += 1
                at, column = k + 1, column + width + 1
                if line[at : at + 1] == " ":
                    at, column = at + 1, column + 1
            elif paragraph and _SETEXT.match(rest) and not all(_DEFINITION.match(t) for t, *_ in self.texts):
                _, first, at_line = next(x for x in self.texts if not _DEFINITION.match(x[0]))
                self.heading(first, at_line, " ".join(t.strip() for t, *_ in self.texts))
                self.leaf = None
                break
            elif m := _ATX.match(rest):
                self.cut_stack(opened)
                self.close_leaf()
                self.heading(start + k, number, m[2] or "" if not re.fullmatch(r"#+", m[2] or "x") else "")
                break
            elif m := _FENCE.match(rest):
                self.cut_stack(opened)
                self.close_leaf()
                self.open_leaf("fence", start + k, number, sign=m[1] or m[3], info=m[2] if m[1] else m[4])
                self.grow(end, number)
                break
            elif _RULE.match(rest):
                self.cut_stack(opened)
                self.close_leaf()
                for c in self.stack:
                    c.empty = False
                break
            elif (m := _ITEM.match(rest)) and len(self.stack) < DEEPEST and not (paragraph and (m.end() == len(rest.rstrip()) or m[2] not in (None, "1"))):
                kind = m[1][-1]
                before = self.stack[opened].of if opened < len(self.stack) else None
                own = before if before is not None and before.kind == kind else _List(kind)
                if own is before and self.blank_before:
                    own.loose = True
                elif self.blank_before and opened and self.stack[opened - 1].of is not None and not self.stack[opened - 1].empty and own is not before:
                    self.stack[opened - 1].of.loose = True
                self.cut_stack(opened)
                if self.leaf == "paragraph":
                    self.close_leaf()
                for c in self.stack:
                    c.empty = False
                at, column = k + m.end(), column + width + m.end()
                gap, behind = _indent(line, at, column)
                inner = gap if 1 <= gap <= 4 and behind < len(line) else 1
                self.stack.append(_Container(width + m.end() + inner, own))
                opened += 1
                self.blank_before = False
                if behind == len(line):
                    break
                at, column = (behind, column + gap) if inner == gap else (at + 1, column + 1)
            elif found := next(((end_, after) for begin, end_, after in _MARKUP if begin.match(rest) and (after or not lazy)), None):
                self.cut_stack(opened)
                self.close_leaf()
                if found[0] is None or not found[0].search(rest):
                    self.open_leaf("markup", start + k, number, until=found[0])
                for c in self.stack:
                    c.empty = False
                break
            else:
                self.text(start + k, end, number, rest, opened, lazy)
                break
            width, k = _indent(line, at, column)
            rest = line[k:]
            if not rest:
                break
        self.blank_before = False

    def text(self, start: int, end: int, number: int, text: str, opened: int, lazy: bool) -> None:
        """A line of text: of the open paragraph, also where its containers' signs are missing, or of a new one."""
        if not (lazy and (opened == self.depth or opened < len(self.stack))):
            self.cut_stack(opened)
            self.close_leaf()
            self.open_leaf("paragraph", start, number)
            self.texts = []
        self.texts.append((text, start, number))
        self.grow(end, number)


def blocks(text: str) -> list[Block]:
    """Sections (a heading to the line before the next one), code blocks and paragraphs; places are of characters."""
    reader, lines, starts = _Reader(), text.split("\n"), [0]
    for number, line in enumerate(lines, 1):
        reader.line(line.removesuffix("\r"), starts[-1], number)
        starts.append(starts[-1] + len(line) + 1)
    reader.close_leaf()
    out = [b for b, own in reader.found if own is None or own.loose]
    nexts = [line for _, line, _ in reader.headings[1:]] + [len(lines) + 1]
    for (start, line, title), after in zip(reader.headings, nexts, strict=False):
        out.append(Block(SECTION, start, starts[after - 1] - 1, line, after - 1, title))
    return out
