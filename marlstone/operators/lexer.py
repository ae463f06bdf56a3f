"""One token stream for a source file: words, strings, numbers, signs, and line ends where they end statements.

Comments and white space are no tokens, strings are one, so what reads the stream never looks inside them. Brackets are paired
by a stack; one that stays open reaches to the end of the file.
"""

from __future__ import annotations

import re

# Comments, strings and words by language.
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'"
_SHAPES = {
    "python": (r"\#[^\n]*", rf"""[rRbBfFuUtT]{{0,2}}(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)|{_QUOTED})""", r"[^\W\d]\w*"),
    "rust": (rf"{_LINE}|{_BLOCK}", r"""b?r(?P<hash>\#*)".*?(?:"(?P=hash)|\Z)|[bc]?"(?:\\.|[^"\\])*"|b?'(?:\\[^'\n]*|[^'\\\n])'""", r"(?:r\#)?[^\W\d]\w*"),
    "go": (rf"{_LINE}|{_BLOCK}", rf"`[^`]*`|{_QUOTED}", r"[^\W\d]\w*"),
    "javascript": (rf"{_LINE}|{_BLOCK}", rf"`(?:\\.|[^`\\])*`|{_QUOTED}", r"\#?(?:[^\W\d]|\$)[\w$]*"),
}
_SHAPES["typescript"] = _SHAPES["javascript"]
LANGUAGES = tuple(_SHAPES)
_LINES_COUNT = {"python", "go"}
# White space before a token is matched with it; what is in no group, a comment or the end of the text, is no token.
_TOKENS = {
    language: re.compile(
        rf"{r'[^\S\n]*+' if language in _LINES_COUNT else r'\s*+'}(?:{comment}|\\\n|{r'(?P<line>\n)|' if language in _LINES_COUNT else ''}(?P<string>{string})|(?P<word>{word})|(?P<number>\d[\w.]*)|(?P<sign>=>|->|::|\?\.|<-|\S)|\Z)", re.S
    )
    for language, (comment, string, word) in _SHAPES.items()
}
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
# Words after which a slash starts a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


#: Characters after which a file is cut, where its language can be read in pieces.
PIECE = 250_000
# Where a line of Python starts a statement of the outermost level.
_OUTER = re.compile(r"\n[^\s#\\]")


class Tokens:
    """kinds, texts, starts and ends of the tokens from a place on; end is the place of the next piece, or the text's end.

    Python is cut before a statement of the outermost level, where no bracket is open: what is read off a piece is what the
    whole file has there. A piece begins with the line end before its first statement. Kinds and texts have empty ones behind
    the last token.
    """

    def __init__(self, text: str, language: str, at: int = 0):
        iterate, script = _TOKENS[language].finditer, language in ("javascript", "typescript")
        limit = at + PIECE if language == "python" else len(text)
        begun, self.end = at, len(text)
        if limit >= len(text) and not (script and "/" in text):
            found = [(m.lastgroup, m.span(m.lastindex)) for m in iterate(text, at) if m.lastindex]
            kinds, spans = [k for k, _ in found], [s for _, s in found]
            texts, starts, ends = [text[a:b] for a, b in spans], [a for a, _ in spans], [b for _, b in spans]
            at = -1
        else:
            kinds, texts, starts, ends = [], [], [], []
        while at >= 0:
            matches, at = iterate(text, at), -1
            for m in matches:
                group = m.lastindex
                if group is None:
                    continue
                kind = m.lastgroup
                a, b = m.span(group)
                if kind == "line" and a > limit and _OUTER.match(text, a):
                    if not _left_open(texts):
                        self.end = a
                        break
                    limit = 2 * a - begun
                part = text[a:b]
                if script and part == "/":
                    last = texts[-1] if texts else ""
                    value = texts and (kinds[-1] in ("number", "string") or last in CLOSE or kinds[-1] == "word" and last not in _BEFORE_REGEX)
                    if not value and (r := _REGEX.match(text, a)):
                        at = b = r.end()
                        kind, part = "string", text[a:b]
                kinds.append(kind)
                texts.append(part)
                starts.append(a)
                ends.append(b)
                if at >= 0:
                    break
        self.kinds, self.texts, self.starts, self.ends, self.n = kinds, texts, starts, ends, len(texts)
        kinds += _PAD
        texts += _PAD


_PAD = [""] * 8


def _left_open(texts: list[str]) -> bool:
    """Whether a bracket is open behind these tokens."""
    opened: list[str] = []
    for t in texts:
        if t in OPEN:
            opened.append(OPEN[t])
        elif t in CLOSE:
            deep = _closed(opened, t)
            if deep >= 0:
                del opened[deep:]
    return bool(opened)


def _closed(opened: list[str], sign: str) -> int:
    """Which of the closing signs that are waited for a sign is, the eight last ones being looked at; -1 if it is none."""
    for d in range(len(opened) - 1, max(len(opened) - 9, -1), -1):
        if opened[d] == sign:
            return d
    return -1


def pairs(texts: list[str], n: int) -> tuple[list[int], list[int], list[int]]:
    """For each token the place of its partner, -1 for what is no bracket, and of the bracket around it (-1: none); the parentheses that open."""
    partner, around, opened, signs, round_, now = [-1] * (n + len(_PAD)), [-1] * n, [], [], [], -1
    for k in range(n):
        t = texts[k]
        if t in _BRACKETS:
            if t in OPEN:
                around[k] = now
                opened.append(k)
                signs.append(OPEN[t])
                now = k
                if t == "(":
                    round_.append(k)
                continue
            # a bracket that closes nothing is left alone, one that closes an outer one closes all within
            deep = _closed(signs, t)
            if deep >= 0:
                for left in opened[deep + 1 :]:
                    partner[left] = k
                partner[opened[deep]], partner[k] = k, opened[deep]
                del opened[deep:], signs[deep:]
                now = opened[-1] if opened else -1
        around[k] = now
    for left in opened:
        partner[left] = n - 1
    return partner, around, round_


_BRACKETS = {*OPEN, *CLOSE}
