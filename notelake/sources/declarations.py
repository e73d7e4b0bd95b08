"""Declarations of Java and TypeScript texts: tokens first, then one pass with a stack of what is open.

Strings, template strings with code inside, text blocks, regular expressions and comments are tokens of their own, so what they hold opens and
closes nothing. A head is recognised by the tokens around a name and ends at its body; whatever lies between its brackets (generics, defaults,
annotations) is skipped by their partners. Names are qualified by the declarations around them, anonymous classes and blocks lend none.

A text that is no program gives what can be told of it and never fails.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Declaration(NamedTuple):
    name: str
    kind: str
    start: int
    end: int
    body: str


class Token(NamedTuple):
    text: str
    at: int
    line: int


_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_WORD = re.compile(r"[#@]?[A-Za-z_$\u00a1-\uffff][\w$]*|\d[\w.]*")
_BLOCK = re.compile(r'"""(?:\\.|[^\\])*?"""', re.S)
_STRING = re.compile(r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'")
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_SIGN = re.compile(r"=>|===?|!==?|<=|>=|&&|\|\||\?\?|\?\.|\.\.\.|::|.", re.S)
_BEFORE_PATTERN = set("( , = : [ ! & | ? { } ; => && || ?? === !== == != return typeof case".split())
PARTNERS = {"(": ")", "[": "]", "{": "}"}
TYPES = {"class", "interface", "enum", "record"}
# words that stand before brackets and are no methods
_NOT_METHODS = set("if for while switch catch return new else do try function synchronized super this throw await typeof import yield with case assert".split())
_NO_STATEMENT = set("= ( , return : ? => new [ && || ?? extends . instanceof".split())
_CONTINUES = set("| & . ? : => extends = , + - * && || ?? ?.".split())


def _template(text: str, at: int) -> int:
    """Where a template string that begins at ``at`` ends; strings inside its code may be templates again."""
    depth, i = [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if not depth and c == "`":
            return i + 1
        if text.startswith("${", i) and (not depth):
            depth.append("}")
            i += 2
            continue
        if depth:
            if c == "`":
                i = _template(text, i)
                continue
            if c in "\"'" and (m := _STRING.match(text, i)):
                i = m.end()
                continue
            if c == "{":
                depth.append("}")
            elif c == "}":
                depth.pop()
        i += 1
    return len(text)


def tokens(text: str, java: bool) -> list[Token]:
    out: list[Token] = []
    at, line, n = 0, 1, len(text)
    while at < n:
        if m := _SPACE.match(text, at):
            line += text.count("\n", at, m.end())
            at = m.end()
            continue
        c = text[at]
        end = None
        if java and (m := _BLOCK.match(text, at)) or c in "\"'" and (m := _STRING.match(text, at)) or (m := _WORD.match(text, at)):
            end = m.end()
        elif c == "`" and not java:
            end = _template(text, at)
        elif c == "/" and not java and (not out or out[-1].text in _BEFORE_PATTERN) and (m := _PATTERN.match(text, at)):
            end = m.end()
        else:
            end = _SIGN.match(text, at).end()
        out.append(Token(text[at:end], at, line))
        line += text.count("\n", at, end)
        at = end
    return out


def _partners(all_: list[Token]) -> list[int]:
    """For each opening bracket the index of its partner (the last token if it has none), else its own."""
    found, open_ = list(range(len(all_))), []
    for i, t in enumerate(all_):
        if t.text in PARTNERS:
            open_.append(i)
        elif t.text in PARTNERS.values():
            while open_:
                j = open_.pop()
                found[j] = i
                if PARTNERS[all_[j].text] == t.text:
                    break
    for j in open_:
        found[j] = len(all_) - 1
    return found


def _name(text: str) -> bool:
    return bool(re.fullmatch(r"#?[A-Za-z_$\u00a1-\uffff][\w$]*", text))


class _Reader:
    def __init__(self, text: str, java: bool):
        self.text, self.java = text, java
        self.t = tokens(text, java)
        self.partner = _partners(self.t)
        self.opener = {j: i for i, j in enumerate(self.partner) if i != j}
        self.types: dict[int, str] = {}  # opening brace of a type's body -> the type's name
        self.inside: int | None = None  # the brace of the type in whose body the reader is

    def word(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def beyond(self, i: int, stop: set[str]) -> int:
        """The first token from ``i`` on, outside brackets, that is one of ``stop``; -1 if there is none."""
        angle = 0
        while i < len(self.t):
            w = self.word(i)
            if w == "<":
                angle += 1
            elif w == ">" and angle:
                angle -= 1
            elif not angle and w in stop:
                return i
            elif w in PARTNERS.values():
                return -1
            i = self.partner[i] + 1
        return -1

    def beyond_angles(self, i: int) -> int:
        """The token after the type parameters at ``i``, if there are any."""
        if self.word(i) != "<":
            return i
        depth = 0
        while i < len(self.t) and self.word(i) not in (";", ")", "}"):
            depth += (self.word(i) == "<") - (self.word(i) == ">")
            i = self.partner[i] + 1
            if not depth:
                return i
        return len(self.t)

    def expression(self, i: int) -> int:
        """The last token of the expression or type that begins at ``i``: up to a semicolon, a comma, a closing bracket or the end of its line."""
        last = i - 1
        while i < len(self.t):
            w = self.word(i)
            if w in (";", ",") or w in PARTNERS.values():
                break
            ends_line = last >= 0 and self.t[i].line > self.t[last].line
            if ends_line and last >= 0 and w not in _CONTINUES and self.word(last) not in _CONTINUES:
                break
            last = self.partner[i]
            i = last + 1
        return last

    def head(self, i: int) -> tuple[int, str, str, int, int] | None:
        """Last token, name, kind and body of the declaration whose head has its word at ``i``."""
        w, name, before = self.word(i), self.word(i + 1), self.word(i - 1)
        if w in TYPES and _name(name) and before not in _NO_STATEMENT and before != "@" and (w != "record" or self.java and self.word(i + 2) in ("(", "<")):
            brace = self.beyond(i + 2, {"{", ";"})
            if brace < 0 or self.word(brace) == ";" or w != "record" and self.word(i + 2) in ("=", ":", ","):
                return None
            self.types[brace] = name
            return self.partner[brace], name, w, brace, self.partner[brace]
        if self.java:
            return self._java_member(i)
        if w == "type" and _name(name) and before not in _NO_STATEMENT and (equal := self.beyond(i + 2, {"=", ";"})) > 0 and self.word(equal) == "=" and self.word(i + 2) in ("=", "<"):
            end = self.expression(equal + 1)
            return end, name, "type", i, end
        if w == "function" and _name(name) and before not in _NO_STATEMENT:
            return self._with_block(name, "function", self.beyond(i + 2, {"("}))
        if w in ("const", "let", "var") and _name(name):
            return self._arrow(i + 1)
        if _name(w) and w not in _NOT_METHODS and self.word(i + 1) in ("(", "<") and before not in ("function", ".", "?.", "new", "=", "=>", "return"):
            start = self.beyond_angles(i + 1)
            return self._with_block(w, "method", start if self.word(start) == "(" else -1)
        return None

    def _with_block(self, name: str, kind: str, params: int) -> tuple[int, str, str, int, int] | None:
        """A function or method: parameters, perhaps a type, a block."""
        if params < 0:
            return None
        after = self.partner[params] + 1
        if self.word(after) == ":":
            after += 1
            if self.word(after) == "{":  # an object type
                after = self.partner[after] + 1
            after = self.beyond(after, {"{", ";"}) if self.word(after) != "{" else after
        if after < 0 or self.word(after) != "{":
            return None
        return self.partner[after], name, kind, after, self.partner[after]

    def _arrow(self, i: int) -> tuple[int, str, str, int, int] | None:
        """A variable whose value is a function."""
        equal = self.beyond(i + 1, {"=", ";", ","})
        if equal < 0 or self.word(equal) != "=":
            return None
        at = equal + 1 + (self.word(equal + 1) == "async")
        if self.word(at) == "function":
            brace = self.beyond(at + 1, {"{"})
            end = self.partner[brace] if brace > 0 else -1
        else:
            at = self.beyond_angles(at)
            if not (self.word(at) == "(" or _name(self.word(at))):
                return None
            sign = self.partner[at] + 1
            if self.word(sign) == ":":
                sign = self.beyond(sign + 1, {"=>", ";"})
            if sign < 0 or self.word(sign) != "=>":
                return None
            end = self.partner[sign + 1] if self.word(sign + 1) == "{" else self.expression(sign + 1)
        return (end, self.word(i), "function", i, end) if end > 0 else None

    def _java_member(self, i: int) -> tuple[int, str, str, int, int] | None:
        """A method or a constructor directly in a type's body."""
        w, before = self.word(i), self.word(i - 1)
        inside = self.inside
        if inside is None or self.word(i + 1) != "(" or not _name(w) or w in _NOT_METHODS:
            return None
        constructor = w == self.types.get(inside) and before != "new"
        if before in TYPES or not constructor and not ((_name(before) and before not in _NOT_METHODS) or before in (">", "]")) or before == "@" or self.word(i - 1).startswith("@"):
            return None
        end = self.beyond(self.partner[i + 1] + 1, {"{", ";", "="})
        if end < 0 or self.word(end) == "=":
            return None
        last = self.partner[end]
        return last, w, "constructor" if constructor else "method", end if self.word(end) == "{" else i, last

    def read(self) -> list[Declaration]:
        scopes: list[tuple[int, str]] = []
        braces: list[int] = []
        out = []
        for i, token in enumerate(self.t):
            while scopes and scopes[-1][0] < i:
                scopes.pop()
            while braces and self.partner[braces[-1]] < i:
                braces.pop()
            self.inside = braces[-1] if braces and braces[-1] in self.types else None
            found = self.head(i) if _name(token.text) else None
            if found:
                last, name, kind, first_of_body, last_of_body = found
                first = self._first(i) if kind != "function" or token.text == "function" else i + 1
                whole = ".".join([*(n for _, n in scopes[-1:]), name])
                end = self.t[last]
                out.append(Declaration(whole, kind, self.t[first].line, end.line + end.text.count("\n"), self.text[self.t[first_of_body].at : self.t[last_of_body].at + len(self.t[last_of_body].text)]))
                scopes.append((last, whole))
            if token.text == "{":
                if i not in self.types and self.java and self._anonymous(i):
                    self.types[i] = ""
                braces.append(i)
        return out

    def _first(self, i: int) -> int:
        """Where a declaration begins: its modifiers, annotations and type belong to it."""
        while i > 0:
            before = self.word(i - 1)
            if before == ")" and (self.java or self.word(self.opener.get(i - 1, 0) - 1).startswith("@")):
                i = self.opener.get(i - 1, i - 1)
            elif before.startswith("@") or before in _MODIFIERS or self.java and before not in (";", "{", "}", "("):
                i -= 1
            else:
                break
        return i

    def _anonymous(self, brace: int) -> bool:
        """Whether a brace opens the body of ``new X(...)``."""
        if self.word(brace - 1) != ")":
            return False
        j = self.opener.get(brace - 1, 0) - 1
        while j >= 0 and (_name(self.word(j)) and self.word(j) != "new" or self.word(j) in ("<", ">", ",", ".", "?")):
            j -= 1
        return j >= 0 and self.word(j) == "new"


_MODIFIERS = set("public private protected static final abstract default export async declare readonly override get set synchronized native strictfp sealed".split())


def declarations(text: str, java: bool) -> list[Declaration]:
    """The declarations of a text in their order."""
    return _Reader(text, java).read()
