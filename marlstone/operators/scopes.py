"""Declarations, calls and imports of a source file, read off its tokens.

Each language has a reader that goes along the tokens once; brackets are jumped over, generic arguments counted through. A
declaration spans from its modifiers to the last token of its body. What it is in is found at the end, by a stack of spans.
"""

from __future__ import annotations

import bisect
import functools
import operator
import re
from typing import NamedTuple

from marlstone.operators.lexer import CLOSE, OPEN, Tokens, pairs

SECTION, FUNCTION, CLASS, STRUCT, METHOD = 0, 3, 4, 5, 6
ANONYMOUS = "<anonymous>"
# Words that are not called although a parenthesis follows, and what may stand before a declaration.
_NEVER_CALLED = "if for while switch return catch function class in else case".split()
NO_CALLS = {
    "python": frozenset([*_NEVER_CALLED, *"def and or not elif except with await yield lambda is del assert raise match import from global".split()]),
    "rust": frozenset([*_NEVER_CALLED, *"fn match pub let const mut ref move impl where async as dyn loop Fn FnMut FnOnce use crate".split()]),
    "go": frozenset([*_NEVER_CALLED, *"func go defer select import type var const range struct interface map chan package".split()]),
    "javascript": frozenset([*_NEVER_CALLED, *"with await yield typeof void delete throw do of instanceof let const var async new".split()]),
}
NO_CALLS["typescript"] = NO_CALLS["javascript"]
_RUST_BEFORE = frozenset("pub const async unsafe extern default".split())
_RUST_STARTS = frozenset("# fn struct enum trait mod impl".split())
_MODIFIERS = frozenset("static async get set public private protected readonly override abstract declare accessor".split())
#: Tokens that are gone along for the end of generic arguments, for the end of a header, and links of a chain of calls.
GENERICS, HEADER, CHAIN = 100, 100, 50
_SCRIPT_STARTS, _BEFORE_BODY = frozenset("class interface type function".split()), frozenset("(<?!")
_SCRIPT_KEYWORDS = frozenset("if for while switch catch with function return typeof await super import new throw case do else".split())


_ENDS_OF_GENERICS = frozenset("<>;{}")


class Declaration(NamedTuple):
    node_type: int
    name: str | None
    start: int
    end: int
    parent: str | None = None
    heading: str | None = None


class Source:
    """Tokens of a file, or of a piece of it, with their partners, and small steps along them."""

    def __init__(self, text: str, language: str, begin: int = 0):
        t = Tokens(text, language, begin)
        self.text, self.language, self.n, self.end = text, language, t.n, t.end
        self.texts, self.kinds, self.starts, self.ends = t.texts, t.kinds, t.starts, t.ends
        self.partner, self.around, self.parentheses = pairs(t.texts, t.n)
        self.places: dict[str, list[int]] = {}

    @functools.cached_property
    def feeds(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)] if self.language not in ("python", "go") else []

    def at(self, k: int) -> str:
        return self.texts[k] if 0 <= k < self.n else ""

    def kind(self, k: int) -> str:
        return self.kinds[k] if 0 <= k < self.n else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < self.n and self.kinds[k] == "word"

    def past(self, k: int) -> int:
        """The place behind a token, or behind its partner if it opens."""
        return self.partner[k] + 1 if 0 <= k < self.n and self.partner[k] > k else k + 1

    def past_generics(self, k: int) -> int:
        """The place behind <...> at k; k if there is none, or no end of it."""
        if self.at(k) != "<" or self.next(">", k) > k + 4 * GENERICS:
            return k
        depth, j, texts, partner = 0, k, self.texts, self.partner
        while j < min(self.n, k + GENERICS):
            t = texts[j]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
            elif t == ";" or t == "}":
                return k
            j = partner[j] + 1 if partner[j] > j else j + 1
            if not depth:
                return j
        return k

    def next(self, sign: str, k: int) -> int:
        if (places := self.places.get(sign)) is None:
            places = self.places[sign] = [k for k, t in enumerate(self.texts) if t == sign]
        at = bisect.bisect_left(places, k)
        return places[at] if at < len(places) else 1 << 60

    def back_generics(self, k: int) -> int:
        """The place of the < that the > at k closes; -1 if there is none near."""
        depth = 0
        for j in range(k, max(k - 60, -1), -1):
            if (t := self.texts[j]) in _ENDS_OF_GENERICS:
                depth += (t == ">") - (t == "<")
                if t in ";{}":
                    return -1
            if not depth:
                return j
        return -1

    def new_line(self, k: int) -> bool:
        """Whether a line ends between a token and the one before it."""
        if k <= 0:
            return True
        at = bisect.bisect_left(self.feeds, self.ends[k - 1])
        return at < len(self.feeds) and self.feeds[at] < self.starts[k]

    def until(self, k: int, stops: str) -> int:
        """The next place, brackets jumped over, of a sign of stops; the number of tokens if there is none."""
        for _ in range(HEADER):
            if k >= self.n or (t := self.texts[k]) in CLOSE:
                break
            if t in stops and t:
                return k
            k = self.partner[k] + 1 if self.partner[k] > k else k + 1
        return self.n

    def cut(self, a: int, b: int) -> str:
        return self.text[self.starts[a] : self.ends[b]] if a <= b else ""


# ---- Python


def _python(s: Source):
    found, named, opened, last = [], set(), [], -1

    def close(indent, end):
        while opened and opened[-1][0] >= indent:
            _, kind, name, start = opened.pop()
            found.append(Declaration(kind, name, s.starts[start], s.ends[end]))

    k, n, texts, kinds, partner = 0, s.n, s.texts, s.kinds, s.partner
    while k < n:
        if kinds[k] == "line":
            k += 1
            continue
        start = s.starts[k]
        line_start = s.text.rfind("\n", 0, start) + 1
        indent = len(s.text[line_start:start].expandtabs(8)) if line_start < start else 0
        if last >= 0:
            close(indent, last)
        stop = k
        while stop < n and kinds[stop] != "line":
            stop = partner[stop] + 1 if partner[stop] > stop else stop + 1
        word = k + 1 if texts[k] == "async" else k
        if texts[word] in ("def", "class") and kinds[word] == "word" and kinds[word + 1] == "word":
            named.add(word + 1)
            opened.append((indent, CLASS if texts[word] == "class" else FUNCTION, texts[word + 1], k))
        last, k = min(stop, n) - 1, stop
    if last >= 0:
        close(0, last)
    return found, named, []


# ---- Rust


def _rust_start(s: Source, k: int) -> int:
    while k > 0:
        if s.at(k - 1) in _RUST_BEFORE and s.is_word(k - 1):
            k -= 1
        elif s.kind(k - 1) == "string" and s.at(k - 2) == "extern":
            k -= 2
        elif s.at(k - 1) == ")" and s.at(s.partner[k - 1] - 1) == "pub":
            k = s.partner[k - 1] - 1
        else:
            break
    return k


def _rust_type(s: Source, k: int) -> tuple[str, int]:
    """The type at k without its last generic arguments, and the place behind it."""
    first, last = k, k - 1
    while k < s.n and s.at(k) not in ("for", "where", "{", ";"):
        if s.at(k) == "<":
            j = s.past_generics(k)
            if s.at(j) == "::":
                last = j - 1
            k = j if j > k else k + 1
            continue
        last, k = (s.past(k) - 1, s.past(k))
    return s.cut(first, last), k


def _rust(s: Source):
    found, named, skipped, k, texts = [], set(), [], 0, s.texts
    while k < s.n:
        word = texts[k]
        if word not in _RUST_STARTS and texts[k + 1] != "!":
            k += 1
            continue
        name = s.at(k + 1) if s.is_word(k + 1) else ""
        if word == "#" and s.at(k + 1 + (s.at(k + 1) == "!")) == "[":
            end = s.past(k + 1 + (s.at(k + 1) == "!"))
            skipped.append((k, end - 1))
            k = end
            continue
        if s.is_word(k) and s.at(k + 1) == "!" and word not in NO_CALLS["rust"]:
            group = k + 2 + s.is_word(k + 2)
            if s.at(group) in OPEN and s.kind(group) == "sign":
                skipped.append((k, s.past(group) - 1))
                k = s.past(group)
                continue
        if not s.is_word(k):
            pass
        elif word == "fn" and name:
            named.add(k + 1)
            j = s.until(s.past_generics(k + 2), "{;")
            if s.at(j) == "{":
                found.append(Declaration(FUNCTION, name, s.starts[_rust_start(s, k)], s.ends[s.partner[j]]))
        elif word in ("struct", "enum", "trait", "mod") and name:
            j = s.until(s.past_generics(k + 2), "{;")
            if j < s.n:
                end = s.partner[j] if s.at(j) == "{" else j
                start = s.starts[_rust_start(s, k)]
                if word == "mod":
                    found.append(Declaration(SECTION, None, start, s.ends[end], heading=f"mod {name}"))
                else:
                    found.append(Declaration(CLASS if word == "trait" else STRUCT, name, start, s.ends[end]))
                if word in ("struct", "enum"):
                    skipped.append((k, end))
        elif word == "impl" and (k == 0 or s.at(k - 1) in (";", "}", "{", "]", "unsafe", "default")):
            name, j = _rust_type(s, s.past_generics(k + 1))
            if s.at(j) == "for":
                name, j = _rust_type(s, j + 1)
            j = s.until(j, "{;")
            if s.at(j) == "{" and name:
                found.append(Declaration(STRUCT, name, s.starts[_rust_start(s, k)], s.ends[s.partner[j]], heading="impl"))
        k += 1
    return found, named, skipped


# ---- Go


def _go_line_end(s: Source, k: int) -> int:
    """The last token of the statement that k is in."""
    while k < s.n and s.kind(k) != "line" and s.at(k) != ";" and not (s.kind(k) == "sign" and s.at(k) in ")}]"):
        k = s.past(k)
    return min(k, s.n) - 1


def _go(s: Source):
    found, named, skipped = [], set(), []
    for k, word in enumerate(s.texts):
        if word != "func" and word != "type":
            continue
        if word == "func" and s.is_word(k) and s.around[k] < 0:
            j, receiver = k + 1, None
            if s.at(j) == "(":
                inner = s.cut(j + 1, s.partner[j] - 1).strip()
                receiver = re.sub(r"^(?:\w+\s+)?\*?\s*", "", inner) or None
                j = s.past(j)
            if not s.is_word(j):
                continue
            name = j
            named.add(j)
            for _ in range(HEADER):
                if j >= s.n or s.kind(j) == "line" or s.at(j) == "{":
                    break
                j = s.past(j + 1) if s.at(j) in ("interface", "struct") and s.at(j + 1) == "{" else s.past(j)
            end = s.partner[j] if s.at(j) == "{" else min(j, s.n) - 1
            found.append(Declaration(METHOD if receiver else FUNCTION, s.at(name), s.starts[k], s.ends[end], receiver))
        elif word == "type" and s.is_word(k) and (k == 0 or s.kind(k - 1) == "line" or s.at(k - 1) in (";", "{")):
            group = s.at(k + 1) == "("
            j, stop, first = (k + 2, s.partner[k + 1], True) if group else (k + 1, k + 2, True)
            while j < stop:
                if s.is_word(j) and s.at(j + 1) != "=":
                    end = _go_line_end(s, j)
                    whole = s.partner[k + 1] if group else end
                    # the first one stands for the whole declaration
                    found.append(Declaration(STRUCT, s.at(j), s.starts[k if first else j], s.ends[whole if first else end]))
                    skipped.append((j, end))
                    first, j = False, end
                elif s.is_word(j):
                    j = _go_line_end(s, j)
                j += 1
    return found, named, skipped


# ---- JavaScript and TypeScript


def _past_type(s: Source, k: int) -> int:
    """The place behind a return type, from its colon at k on; k if there is none."""
    if s.at(k) != ":":
        return k
    j = k + 1
    if s.at(j) == "{":
        j = s.past(j)
    for _ in range(HEADER):
        if s.is_word(j) and s.is_word(j - 1) and s.new_line(j):
            break
        if s.at(j) == "<":
            j = max(s.past_generics(j), j + 1)
        elif s.at(j) in ("(", "["):
            j = s.past(j)
        elif s.at(j) in ("|", "&") and s.at(j + 1) == "{":
            j = s.past(j + 1)
        elif s.is_word(j) or s.kind(j) == "string" or s.at(j) in (".", "|", "&", "?"):
            j += 1
        else:
            break
    return j


def _expression_end(s: Source, k: int) -> int:
    """The last token of the expression or type at k: before a comma, semicolon or closing bracket, or where a line ends it."""
    j, first = k, k
    while j < s.n:
        if s.kind(j) == "sign" and (s.at(j) in ",;" or s.at(j) in ")]}"):
            break
        goes_on = s.at(j) in (".", "?.", "?", ":", "+", "-", "*", "/", "%", "&", "|", "=", "<", ">", "(", "[", "=>") and s.kind(j) == "sign"
        before = s.kind(j - 1) == "sign" and s.at(j - 1) not in (")", "]", "}", ">")
        if j > first and s.new_line(j) and not goes_on and not before:
            break
        j = s.past(j)
    return j - 1


def _script(s: Source):
    found, named, types, classes, k, texts, kinds = [], set(), [], [], 0, s.texts, s.kinds
    begins = lambda: k == 0 or texts[k - 1] in (";", "}", "{", "export", "default", "declare", "abstract") or s.new_line(k)
    typed, type_end = s.language == "typescript", -1
    #: Last token of the expression that an arrow of the same brackets has for a body.
    reach: dict[int, int] = {}
    while k < s.n:
        word, kind = texts[k], kinds[k]
        if kind == "word" or kind == "string":
            # what is no keyword is a method at most, with parameters behind its name
            if word not in _SCRIPT_STARTS and texts[k + 1] not in _BEFORE_BODY:
                k += 1
                continue
        elif word != "=>" and word != "[":
            k += 1
            continue
        free = texts[k - 1] not in (".", "?.") if k else True
        if word == "class" and free and s.is_word(k):
            name = s.at(k + 1) if s.is_word(k + 1) and s.at(k + 1) not in ("extends", "implements") else ""
            j = _brace(s, k + 1)
            if j >= 0 and not (s.at(k + 1) in (":", "=", ",", ")")):
                found.append(Declaration(CLASS, name or _bound_name(s, k) or "", s.starts[k - (s.at(k - 1) == "abstract")], s.ends[s.partner[j]]))
                classes.append(j)
        elif word == "interface" and free and s.is_word(k + 1) and begins():
            if (j := _brace(s, k + 2)) >= 0:
                found.append(Declaration(STRUCT, s.at(k + 1), s.starts[k], s.ends[s.partner[j]]))
                types.append((k, s.partner[j]))
                type_end = max(type_end, s.partner[j])
        elif word == "type" and free and s.is_word(k + 1) and begins() and s.at(s.past_generics(k + 2)) == "=":
            end = _expression_end(s, s.past_generics(k + 2) + 1)
            stop = end + 1 if s.at(end + 1) == ";" else end
            found.append(Declaration(STRUCT, s.at(k + 1), s.starts[k], s.ends[stop]))
            types.append((k, end))
            type_end = max(type_end, end)
        elif word == "function" and free and s.is_word(k):
            j = k + 1 + (s.at(k + 1) == "*")
            if s.is_word(j):
                named.add(j)
                start = k - 1 if s.at(k - 1) == "async" else k
                statement = start == 0 or s.at(start - 1) in (";", "}", "{", "export", "default", ")") or s.new_line(start) and s.at(start - 1) not in ("=", "(", ",", ":", "?", "return")
                body = _body(s, j + 1)
                if body >= 0 and statement:
                    found.append(Declaration(FUNCTION, s.at(j), s.starts[start], s.ends[s.partner[body]]))
        elif word == "=>" and k > type_end:
            arrow = _arrow(s, k, typed, classes)
            if arrow is not None:
                if s.at(k + 1) == "{":
                    end = s.partner[k + 1]
                else:
                    # an arrow in the body of another one ends where that ends
                    end = reach[s.around[k]] if reach.get(s.around[k], -1) > k else _expression_end(s, k + 1)
                    reach[s.around[k]] = end
                if end > k:
                    found.append(Declaration(FUNCTION, _bound_name(s, arrow) or ANONYMOUS, s.starts[arrow], s.ends[end]))
        elif free and s.at(k - 1) not in ("new", "function") and k > type_end and (s.is_word(k) and word not in _SCRIPT_KEYWORDS or not s.is_word(k)):
            j = s.past(k) if word == "[" else k + 1
            if word != "*" and (word != "[" or s.at(k - 1) in ("{", "}", ";", "*", ",") or s.at(k - 1) in _MODIFIERS):
                j += s.at(j) in ("?", "!")
                body = _body(s, j) if s.at(j) in ("(", "<") else -1
                if body >= 0 and s.at(k - 1 - (s.at(k - 1) == "*")) != "function":
                    start = k
                    while s.at(start - 1) == "*" or s.at(start - 1) in _MODIFIERS and s.is_word(start - 1) and not (s.new_line(start) and s.at(start - 1) in ("get", "set")):
                        start -= 1
                    named.add(k)
                    name = s.cut(k, j - 1).rstrip("?!") if word == "[" else word
                    found.append(Declaration(METHOD, name, s.starts[start], s.ends[s.partner[body]]))
        k += 1
    # members of classes that have no body are no calls either
    for j in classes:
        m = j + 1
        while m < s.partner[j]:
            if s.is_word(m) and s.at(m + 1) in ("(", "<") and (s.at(m - 1) in ("{", "}", ";", "*") or s.at(m - 1) in _MODIFIERS or s.new_line(m)):
                named.add(m)
            m = s.past(m)
    return found, named, types


def _brace(s: Source, k: int) -> int:
    """The brace that opens the body of a class or interface whose header goes on at k; -1 if there is none."""
    for _ in range(HEADER):
        if k >= s.n or s.at(k) == ";":
            break
        if s.at(k) == "{":
            return k
        k = max(s.past_generics(k), k + 1) if s.at(k) == "<" else s.past(k)
    return -1


def _body(s: Source, k: int) -> int:
    """The brace of the body behind parameters, and type parameters before them, at k; -1 if there is none."""
    j = s.past_generics(k)
    if s.at(j) != "(" or s.partner[j] <= j:
        return -1
    j = _past_type(s, s.past(j))
    return j if s.at(j) == "{" and s.kind(j) == "sign" else -1


def _arrow(s: Source, k: int, typed: bool, classes: list[int]) -> int | None:
    """The first token of the function whose arrow is at k; None for a type of functions."""
    j = k - 1
    if typed and s.at(j) != ")":
        # a return type stands between the parameters and the arrow
        m = j
        while m > max(k - 40, 0) and not (s.at(m) == ":" and s.at(m - 1) == ")"):
            if s.at(m) in (";", "{", "=>", "="):
                break
            m = s.partner[m] - 1 if s.at(m) in (")", "]", "}") and 0 <= s.partner[m] < m else m - 1
        if s.at(m) == ":" and s.at(m - 1) == ")" and _past_type(s, m) == k:
            j = m - 1
    if s.at(j) == ")" and s.partner[j] >= 0:
        start = s.partner[j]
        if typed and s.at(start - 1) == ">" and (g := s.back_generics(start - 1)) >= 0:
            start = g
    elif s.is_word(j):
        start = j
    else:
        return None
    if s.at(start - 1) == "async" and s.is_word(start - 1):
        start -= 1
    before = s.at(start - 1)
    if typed and before in ("|", "&", "<", "new", "is", "keyof", "as", "extends"):
        return None
    if typed and before == ":":
        around = s.around[start]
        member = around >= 0 and (around in classes or s.at(around) == "(" and s.at(s.past(around)) in ("=>", ":", "{"))
        variable = any(s.at(m) in ("const", "let", "var") for m in range(start - 3, start - 1) if m >= 0)
        if member or variable:
            return None
    return start


def _bound_name(s: Source, k: int) -> str | None:
    """The name that a value at k is bound to, as a variable or a field."""
    if s.at(k - 1) != "=":
        return None
    if s.is_word(k - 2) and s.at(k - 3) not in (":", ".", "?.", "=>", "|", "&"):
        return s.at(k - 2)
    for m in range(k - 2, max(k - 60, 0), -1):
        if s.at(m) in (";", "{", "}", "=") and s.around[m] == s.around[k]:
            break
        if s.at(m) == ":" and s.is_word(m - 1) and s.around[m] == s.around[k] and (s.at(m - 2) in ("const", "let", "var") or s.new_line(m - 1) or s.at(m - 2) in _MODIFIERS):
            return s.at(m - 1)
    return None


_READERS = {"python": _python, "rust": _rust, "go": _go, "javascript": _script, "typescript": _script}


def _nested(found: list[Declaration], language: str) -> list[Declaration]:
    """Declarations in order, with the name of the class, trait or impl around each, by a stack of the open ones."""
    out, opened = [], []
    for node_type, name, start, end, parent, heading in sorted(found, key=lambda d: (d[2], -d[3])):
        while opened and opened[-1][0] <= start:
            opened.pop()
        parent = parent or next((o for _, o in reversed(opened) if o), None)
        if node_type == CLASS or heading == "impl":
            opened.append((end, name))
        if node_type == FUNCTION and parent and language == "python":
            node_type = METHOD
        out.append(Declaration(node_type, name, start, end, parent, None if heading == "impl" else heading))
    return out


def pieces(text: str, language: str):
    """The file as Sources, one after another, each of which can be read by itself."""
    at = 0
    while True:
        s = Source(text, language, at)
        yield s
        at = s.end
        if at >= len(text):
            return


def declared(s: Source) -> list[Declaration]:
    return _nested(_READERS[s.language](s)[0], s.language)


def declarations(text: str, language: str) -> list[Declaration]:
    return [d for s in pieces(text, language) for d in declared(s)]


# ---- references


class Reference(NamedTuple):
    name: str
    qualifier: str | None
    start: int
    end: int
    ref_type: str


_LINKS = (".", "::", "?.")
_PLACE = operator.itemgetter(2, 3, 0)


def _calls(s: Source, named: set[int], skipped: list[tuple[int, int]]):
    generic, none = s.language in ("typescript", "rust"), NO_CALLS[s.language]
    starts, reach = [a for a, _ in skipped], []
    for _, b in skipped:
        reach.append(max(b, reach[-1]) if reach else b)
    texts, kinds, partner = s.texts, s.kinds, s.partner
    for k in s.parentheses:
        last = k - 1
        if k == 0 or partner[k] <= k or kinds[last] != "word" and not (generic and texts[last] == ">"):
            continue
        at = bisect.bisect_left(starts, k) - 1
        if at >= 0 and reach[at] >= k:
            continue
        if generic and s.at(last) == ">" and s.kind(last) == "sign" and (g := s.back_generics(last)) > 0:
            last = g - 1 - (s.at(g - 1) == "::")
        if not s.is_word(last) or last in named or texts[last] in none and texts[last - 1] not in _LINKS:
            continue
        first = last
        for _ in range(CHAIN):
            if texts[first - 1] not in _LINKS or first < 2:
                break
            j = first - 2
            while s.at(j) in (")", "]") and 0 < s.partner[j] < j:
                j = s.partner[j] - 1
            if not (s.is_word(j) and (s.at(j) not in none or s.at(j - 1) in _LINKS) or s.kind(j) in ("string", "number")):
                # what is in parentheses or brackets may itself be the start
                j += 1
                if j >= first - 1:
                    break
                first = j
                break
            first = j
        if texts[first - 1] == "new" and s.is_word(first - 1):
            continue
        qualifier = s.cut(first, last - 2) if first < last - 1 else None
        yield Reference(texts[last], qualifier, s.starts[first], s.ends[s.partner[k]], "call")


def _use(s: Source, k: int, stop: int, out: list[Reference]) -> None:
    """The names of a Rust use tree from k to stop."""
    while k < stop:
        first = k
        while k < stop and (s.is_word(k) or s.at(k) == "::") and s.at(k) != "as":
            k += 1
        path = [j for j in range(first, k) if s.is_word(j)]
        # what stands before a list of names is a name as well, what stands before a star is not
        if path and s.at(k) != "*" and s.at(path[-1]) not in ("self", "crate", "super"):
            qualifier = s.cut(first, path[-2]) if len(path) > 1 else None
            out.append(Reference(s.at(path[-1]), qualifier, s.starts[first], s.ends[path[-1]], "import"))
        if s.at(k) == "{":
            _use(s, k + 1, s.partner[k], out)
        while k < stop and s.at(k) != ",":
            k = s.past(k)
        k += 1


def _imports(s: Source):
    out: list[Reference] = []
    one = lambda k, b=None, name=None, q=None: out.append(Reference(name or s.cut(k, b or k), q, s.starts[k], s.ends[b or k], "import"))
    n, language = s.n, s.language

    def dotted(k: int) -> int:
        """The last token of a dotted name at k."""
        while s.at(k + 1) == "." and s.is_word(k + 2):
            k += 2
        return k

    for k, word in enumerate(s.texts):
        if word != "import" and word != "from" and word != "use" or s.kinds[k] != "word":
            continue
        if language == "python" and word in ("import", "from") and (k == 0 or s.kind(k - 1) == "line" and s.around[k] < 0 or s.at(k - 1) in (";", ":")):
            j, stop = k + 1, k + 1
            while stop < n and s.kind(stop) != "line" and s.at(stop) != ";":
                stop = s.past(stop)
            if word == "from":
                if s.at(j) == "__future__":
                    continue
                if s.is_word(j) and s.at(j) != "import":
                    one(j, dotted(j))
                while j < stop and s.at(j) != "import":
                    j += 1
                j += 1
            while j < stop:
                if s.is_word(j):
                    end = dotted(j)
                    alias = s.at(end + 1) == "as" and s.is_word(end + 2)
                    one(j, end + 2 * alias, s.cut(j, end))
                    while j < stop and s.at(j) != ",":
                        j += 1
                j += 1
        elif language == "rust" and word == "use" and (k == 0 or s.at(k - 1) in (";", "}", "{", "]", "pub", ")")):
            _use(s, k + 1, s.until(k + 1, ";"), out)
        elif language == "go" and word == "import" and (k == 0 or s.kind(k - 1) == "line" or s.at(k - 1) == ";"):
            j, stop = (k + 2, s.partner[k + 1]) if s.at(k + 1) == "(" else (k + 1, k + 3)
            while j < min(stop, n):
                if s.kind(j) == "string":
                    path = s.at(j)[1:-1]
                    alias = j - 1 > k and s.kind(j - 1) != "line" and s.at(j - 1) not in ("(", ";")
                    if path.rsplit("/", 1)[-1]:
                        one(j - 1 if alias else j, j, path.rsplit("/", 1)[-1], path)
                    if stop == k + 3:
                        break
                j += 1
        elif language in ("javascript", "typescript") and word == "import" and s.at(k + 1) not in ("(", ".") and s.at(k - 1) not in (".", "?."):
            j = k + 1 + (s.at(k + 1) == "type" and s.at(k + 2) not in ("from", ","))
            while j < n and s.kind(j) != "string" and s.at(j) not in (";", "from", "="):
                if s.is_word(j) and s.at(j) not in ("as", "type", "default"):
                    one(j)
                j += 1
    return out


def references(text: str, language: str) -> list[Reference]:
    """Imported names and calls, in order of their start."""
    return [r for s in pieces(text, language) for r in referred(s)]


def referred(s: Source) -> list[Reference]:
    _, named, skipped = _READERS[s.language](s)
    return _in_order(s, named, skipped)


def _in_order(s: Source, named: set[int], skipped: list[tuple[int, int]]) -> list[Reference]:
    return sorted([*_imports(s), *_calls(s, named, sorted(skipped))], key=_PLACE)


def read(s: Source) -> tuple[list[Declaration], list[Reference]]:
    """Declarations and references of a piece, each in order of their start."""
    found, named, skipped = _READERS[s.language](s)
    return _nested(found, s.language), _in_order(s, named, skipped)
