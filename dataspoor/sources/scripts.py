"""JavaScript and TypeScript programs as relations: one row a statement.

A tokenizer and a recursive-descent reader of our own, since no grammar library
is at hand. It reads and lowers in one pass: names, members, calls, functions,
classes, patterns, templates, and type annotations as far as they must be
skipped. What it can't read ends at the next statement, and is a `parse_error`.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parsed
from .python import _FIELDS, IR, MODULE

_TOKEN = re.compile(
    r"""(?P<space>[\s﻿]+|//[^\n]*|/\*(?s:.*?)\*/|^\#![^\n]*)
    |(?P<num>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
    |(?P<name>[$\w]+|\#[$\w]+|@[$\w]+)
    |(?P<str>"(?:[^"\\\n]|\\(?s:.))*"|'(?:[^'\\\n]|\\(?s:.))*')
    |(?P<punct>\.\.\.|=>|\?\?=|\*\*=|&&=|\|\|=|<<=|>>>=|>>=|===|!==|\*\*|\?\?|\?\.(?!\d)|&&|\|\||==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%=<>!&|^~?:;,.(){}\[\]])""",
    re.X,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_AFTER_VALUE = {")", "]", "}", "++", "--"}
_KEYWORDS_BEFORE_EXPR = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "await", "yield", "else", "do", "instanceof"}
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_TESTS = {"==", "!=", "===", "!==", "<", ">", "<=", ">=", "instanceof", "in"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "&=", "|=", "^=", "??=", "||=", "&&=", "<<=", ">>=", ">>>="}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_MODIFIERS = {"public", "private", "protected", "readonly", "static", "override", "abstract", "declare", "async", "get", "set", "accessor"}


class Unreadable(Exception):
    pass


class Token:
    __slots__ = ("at", "end", "kind", "line_break", "parts", "text")

    def __init__(self, kind, text, at, end, line_break, parts=None):
        self.kind, self.text, self.at, self.end, self.line_break, self.parts = kind, text, at, end, line_break, parts


def _template(text: str, at: int) -> tuple[int, list]:
    """End of a template and its parts: (literal) or (start, end) of an expression."""
    parts, k, lit = [], at + 1, at + 1
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
        elif c == "`":
            parts.append(text[lit:k])
            return k + 1, parts
        elif text.startswith("${", k):
            parts.append(text[lit:k])
            depth, s = 1, k + 2
            k = s
            while k < len(text) and depth:
                if text[k] == "`":
                    k = _template(text, k)[0]
                    continue
                if text[k] in "\"'":
                    q, k = text[k], k + 1
                    while k < len(text) and text[k] != q:
                        k += 2 if text[k] == "\\" else 1
                depth += (text[k : k + 1] == "{") - (text[k : k + 1] == "}")
                k += 1
            parts.append((s, k - 1))
            lit = k
        else:
            k += 1
    raise Unreadable("unclosed template")


def _is_value(last: Token | None) -> bool:
    """Whether a token ends a value, so that a slash after it divides."""
    return last is not None and (last.kind in ("num", "str", "tpl", "regex") or last.text in _AFTER_VALUE or (last.kind == "name" and last.text not in _KEYWORDS_BEFORE_EXPR))


def tokens(text: str, start: int = 0, stop: int | None = None) -> list[Token]:
    out: list[Token] = []
    k, stop, broke = start, len(text) if stop is None else stop, False
    while k < stop:
        c = text[k]
        if c == " ":
            k += 1
            continue
        last = out[-1] if out else None
        if c == "`":
            end, parts = _template(text, k)
            out.append(Token("tpl", text[k:end], k, end, broke, parts))
            k, broke = end, False
            continue
        if c == "/" and text[k + 1 : k + 2] not in "/*" and not _is_value(last) and (m := _REGEX.match(text, k)):
            out.append(Token("regex", m[0], k, m.end(), broke))
            k, broke = m.end(), False
            continue
        m = _TOKEN.match(text, k, stop)
        if not m:
            k += 1
            continue
        kind, said, end = m.lastgroup, m[0], m.end()
        if kind == "space":
            broke = broke or "\n" in said
        else:
            out.append(Token(kind, said, k, end, broke))
            broke = False
        k = end
    out.append(Token("end", "", stop, stop, True))
    return out


class Reader:
    """Lowers one file. Conventions are those of sources.python.Lowering."""

    def __init__(self, repo: str, path: str, text: str):
        self.repo, self.path, self.text, self.rows, self.n, self.fns = repo, path, text, [], 0, 0
        self.toks, self.i = tokens(text), 0
        self.fn, self.cls, self.scopes = MODULE, None, [set()]
        self.known: dict[str, str] = {}
        functions = re.findall(r"\b(?:function\*?|class)\s+([$\w]+)|\b(?:const|let|var)\s+([$\w]+)\s*=\s*(?:async\s*)?(?:[(<]|[$\w]+\s*=>)", text)
        self.defined = {a or b for a, b in functions}
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    # ---- tokens
    @property
    def t(self) -> Token:
        return self.toks[self.i]

    def peek(self, n: int = 1) -> str:
        return self.toks[min(self.i + n, len(self.toks) - 1)].text

    def at(self, *texts: str) -> bool:
        t = self.toks[self.i]
        return t.text in texts and t.kind not in ("str", "tpl")

    def take(self, text: str | None = None) -> Token:
        t = self.t
        if text is not None and t.text != text:
            raise Unreadable(f"expected {text}")
        if t.kind == "end":
            raise Unreadable("end of file")
        self.i += 1
        return t

    def accept(self, *texts: str) -> bool:
        t = self.toks[self.i]
        if t.text in texts and t.kind not in ("str", "tpl"):
            self.i += 1
            return True
        return False

    def match(self, i: int) -> int:
        """Index of the bracket that closes the one at i."""
        depth = 0
        for k in range(i, len(self.toks)):
            x = self.toks[k].text if self.toks[k].kind == "punct" else ""
            depth += (x in _PAIRS) - (x in (")", "]", "}"))
            if not depth:
                return k
        raise Unreadable("unclosed bracket")

    def skip_group(self) -> None:
        self.i = self.match(self.i) + 1

    def skip_angle(self) -> None:
        depth = 0
        while True:
            x = self.take().text
            depth += (x == "<") - x.count(">") * (x in (">", ">>", ">>>"))
            if depth <= 0:
                return

    def skip_type(self) -> None:
        while True:
            while self.at("|", "&", "keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "-", "+"):
                self.i += 1
            group = self.at("(")
            if self.at("(", "[", "{"):
                self.skip_group()
            elif self.at("<"):
                self.skip_angle()
                continue
            elif self.t.kind in ("name", "str", "num", "tpl"):
                self.i += 1
            else:
                return
            while True:
                if self.at(".") and not self.t.line_break:
                    self.i += 2
                elif self.at("<"):
                    self.skip_angle()
                elif self.at("[") and not self.t.line_break:
                    self.skip_group()
                else:
                    break
            if (group and self.at("=>") or self.at("is", "extends", "|", "&", "?")) and not (self.at("?") and self.peek() in (")", ",", ":", "=")):
                conditional = self.accept("?")
                if not conditional:
                    self.i += 1
                else:
                    self.skip_type()
                    self.accept(":")
                continue
            return

    # ---- rows
    def var(self, name: str, fn: str | None = None) -> str:
        return f"{self.repo}|{self.path}|{fn or self.fn}|{name}"

    def temp(self) -> str:
        self.n += 1
        return self.var(f"%{self.n}")

    def add(self, kind: str, at: int, **more) -> None:
        line = bisect_right(self.starts, at)
        end = self.toks[self.i - 1].end if self.i else at
        said = " ".join(self.text[at:end].split())
        row = {"repo": self.repo, "path": self.path, "n": len(self.rows), "kind": kind, "fn": self.fn, "text": said if len(said) <= 80 else said[:79] + "…", "line": line, "col": at - self.starts[line - 1] + 1}
        self.rows.append(row | more)

    def place(self, name: str) -> str:
        return self.var(name) if self.fn == MODULE or name in self.scopes[-1] else self.var(name, MODULE)

    def api_of(self, name: str) -> str | None:
        got = self.known.get(f"{self.fn}|{name}") or self.known.get(f"{MODULE}|{name}")
        if got:
            return got
        declared = name in self.scopes[-1] or name in self.scopes[0] or name in self.defined
        return None if declared else name

    # ---- statements
    def run(self) -> list[dict]:
        self.scopes[0] |= set(re.findall(r"^(?:export\s+)?(?:const|let|var)\s+([$\w]+)", self.text, re.M))
        while self.t.kind != "end":
            self.statement_or_skip()
        return self.rows

    def statement_or_skip(self) -> None:
        began = self.i
        try:
            self.statement()
        except (Unreadable, IndexError, RecursionError) as e:
            self.i = max(self.i, began + 1)
            self.i = min(self.i, len(self.toks) - 1)
            self.add("parse_error", self.toks[min(began, len(self.toks) - 1)].at, text=str(e)[:80])
            while self.t.kind != "end" and not self.accept(";") and not self.t.line_break:
                self.i += 1

    def block(self) -> None:
        self.take("{")
        while not self.at("}"):
            if self.t.kind == "end":
                raise Unreadable("unclosed block")
            self.statement_or_skip()
        self.take("}")

    def statement(self) -> None:
        t = self.t
        if self.accept(";"):
            return
        if self.at("{"):
            return self.block()
        while self.t.kind == "name" and self.t.text.startswith("@"):
            self.i += 1
            while self.accept("."):
                self.i += 1
            if self.at("("):
                self.arguments()
        word = self.t.text if self.t.kind == "name" else ""
        if word == "import" and self.peek() not in ("(", "."):
            return self.imports()
        if word == "export":
            self.i += 1
            row, default = len(self.rows), self.accept("default")
            if self.at("{", "*"):
                while not self.accept(";") and not (self.t.line_break and self.toks[self.i - 1].text != ","):
                    self.i += 1
                return None
            if not (self.t.kind == "name" and self.t.text in ("const", "let", "var", "function", "class", "async", "interface", "type", "enum", "abstract", "declare", "namespace")):
                self.expression()
                self.exported(row, default)
                return self.end()
            self.statement()
            return self.exported(row, default)
        if word in ("declare", "abstract"):
            self.i += 1
            return self.statement()
        if word in ("interface", "namespace", "enum") or (word == "const" and self.peek() == "enum"):
            while not self.at("{"):
                self.take()
            return self.skip_group()
        if word == "type" and self.toks[self.i + 1].kind == "name" and self.peek(2) in ("=", "<"):
            self.i += 2
            if self.at("<"):
                self.skip_angle()
            self.take("=")
            self.skip_type()
            return self.end()
        if word in ("const", "let", "var"):
            self.i += 1
            self.declarations()
            return self.end()
        if word == "function" or (word == "async" and self.peek() == "function"):
            self.function()
            return None
        if word == "class":
            return self.klass()
        if word == "return":
            self.i += 1
            if not self.at(";", "}") and not self.t.line_break:
                self.add("return", t.at, src=self.expression(), dst=self.var("%return"))
            return self.end()
        if word == "throw":
            self.i += 1
            self.add("throw", t.at, src=self.expression(), dst=self.var("%throw"))
            return self.end()
        if word in ("if", "while", "switch", "with"):
            self.i += 1
            self.take("(")
            self.expression()
            self.take(")")
            if word == "switch":
                return self.block()
            self.statement()
            if word == "if" and self.accept("else"):
                self.statement()
            return None
        if word in ("case", "default") and word == "case" or (word == "default" and self.peek() == ":"):
            self.i += 1
            if word == "case":
                self.expression()
            self.take(":")
            return None
        if word == "for":
            return self.loop()
        if word == "do":
            self.i += 1
            self.statement()
            self.take("while")
            self.skip_group()
            return self.end()
        if word == "try":
            self.i += 1
            self.block()
            if self.accept("catch"):
                if self.accept("("):
                    self.pattern(self.var("%throw"), t.at)
                    self.take(")")
                self.block()
            if self.accept("finally"):
                self.block()
            return None
        if word in ("break", "continue", "debugger"):
            self.i += 1
            if self.t.kind == "name" and not self.t.line_break:
                self.i += 1
            return self.end()
        if self.t.kind == "name" and self.peek() == ":" and word not in ("default",):
            self.i += 2
            return self.statement()
        self.expression()
        return self.end()

    def end(self) -> None:
        if not self.accept(";") and not self.at("}") and not self.t.line_break and self.t.kind != "end":
            raise Unreadable(f"unexpected {self.t.text}")

    def exported(self, row: int, default: bool) -> None:
        """Marks the function that the rows from `row` on declare at this level with the name it is exported by."""
        made = [r for r in self.rows[row:] if r["kind"] == "func" and "." not in r["fn"]]
        if made:
            held = next((r["dst"].split("|")[-1] for r in self.rows[row:] if r["kind"] == "assign" and r["src"] == self.var(f"fn:{made[0]['fn']}", MODULE)), made[0]["field"])
            made[0]["parts"] = ["export:default" if default else f"export:{held}"]

    def imports(self) -> None:
        self.take("import")
        found: list[tuple[str, str]] = []
        self.accept("type") if self.peek() not in ("from", ",") else None
        if self.t.kind == "str":
            self.add("import", self.t.at, callee=self.take().text[1:-1])
            return self.end()
        while not self.at("from"):
            if self.accept("{"):
                while not self.accept("}"):
                    self.accept("type") if self.peek() not in ("as", ",", "}") else None
                    name = self.take().text
                    found.append((self.take().text if self.accept("as") else name, name))
                    self.accept(",")
            elif self.accept("*"):
                self.take("as")
                found.append((self.take().text, ""))
            elif not self.accept(","):
                found.append((self.take().text, "default"))
        self.take("from")
        at = self.t.at
        module = self.take().text[1:-1]
        self.add("import", at, callee=module)
        for local, name in found:
            self.known[f"{self.fn}|{local}"] = f"{module}:{name}"
        if self.accept("with", "assert"):
            self.skip_group()
        return self.end()

    def declarations(self) -> None:
        while True:
            at = self.t.at
            mark = self.i
            simple = self.t.text if self.t.kind == "name" else None
            if self.at("{", "["):
                self.skip_group()
            else:
                self.i += 1
            self.accept("!")
            if self.accept(":"):
                self.skip_type()
            if self.accept("="):
                if simple and self.arrow_ahead():
                    self.function(name=simple)
                    self.scopes[-1].add(simple)
                else:
                    src, api = self.assignment(), self.last_api
                    after = self.i
                    self.i = mark
                    self.pattern(src, at, api)
                    self.i = after
            elif simple:
                self.scopes[-1].add(simple)
            if not self.accept(","):
                return

    def pattern(self, src: str, at: int, api: str | None = None) -> None:
        """Binds a name or a destructuring pattern to a value."""
        if self.accept("{"):
            while not self.accept("}"):
                if self.accept("..."):
                    self.pattern(src, at)
                else:
                    key = self.take()
                    name = key.text.strip("'\"")
                    if key.text == "[":
                        self.assignment()
                        self.take("]")
                        name = None
                    out = self.temp()
                    self.add("load", key.at, dst=out, obj=src, field=name, callee=f"{api}.{name}" if api else None, text=name)
                    member = self.joined(api, name) if api and name else None
                    if self.accept(":"):
                        self.pattern(out, key.at, member)
                    else:
                        self.bind(name, out, key.at, member)
                    if self.accept("="):
                        self.assignment()
                self.accept(",")
            return
        if self.accept("["):
            while not self.accept("]"):
                if not self.accept(","):
                    self.accept("...")
                    self.pattern(src, at)
                    if self.accept("="):
                        self.assignment()
            return
        self.bind(self.take().text, src, at, api)
        self.accept("?")
        if self.accept(":"):
            self.skip_type()

    def bind(self, name: str, src: str, at: int, api: str | None) -> None:
        self.scopes[-1].add(name)
        if api:
            self.known[f"{self.fn}|{name}"] = api
        self.add("assign", at, dst=self.var(name), src=src)

    def loop(self) -> None:
        self.take("for")
        self.accept("await")
        self.take("(")
        if self.at("const", "let", "var") and (self.find("of") or self.find("in")):
            self.i += 1
            mark = self.i
            while not self.at("of", "in"):
                self.skip_group() if self.at("{", "[") else self.take()
            at = self.t.at
            self.i += 1
            src = self.expression()
            after, self.i = self.i, mark
            out = self.temp()
            self.add("iterate", at, dst=out, src=src)
            self.pattern(out, at)
            self.i = after
        else:
            if self.at("const", "let", "var"):
                self.i += 1
                self.declarations()
            elif not self.at(";"):
                self.expression()
            while self.accept(";"):
                if not self.at(";", ")"):
                    self.expression()
        self.take(")")
        self.statement()

    def find(self, word: str) -> bool:
        end, depth = self.match(self.i - 1), 0
        for k in range(self.i, end):
            x = self.toks[k]
            if x.kind == "punct":
                depth += (x.text in _PAIRS) - (x.text in (")", "]", "}"))
            if x.text == word and x.kind == "name" and not depth:
                return True
            if x.text == ";":
                return False
        return False

    # ---- functions
    def arrow_ahead(self) -> bool:
        i = self.i + (self.at("async") and not self.toks[self.i + 1].line_break)
        t = self.toks[i]
        if t.text == "function":
            return True
        if t.text == "<" and t.kind == "punct":
            depth = 0
            while i < len(self.toks) - 1:
                depth += (self.toks[i].text == "<") - (self.toks[i].text == ">")
                i += 1
                if not depth:
                    break
            t = self.toks[i]
        if t.kind == "name":
            return self.toks[i + 1].text == "=>"
        if t.text != "(" or t.kind != "punct":
            return False
        j = self.match(i) + 1
        if self.toks[j].text == "=>":
            return True
        if self.toks[j].text == ":":
            held, self.i = self.i, j + 1
            try:
                self.skip_type()
                return self.at("=>")
            except Unreadable:
                return False
            finally:
                self.i = held
        return False

    def function(self, name: str | None = None, owner: str | None = None) -> str:
        """Reads a function of any form; the variable that holds it."""
        t, outer, held = self.t, self.fn, self.cls
        self.accept("async")
        if self.accept("function"):
            self.accept("*")
            if self.t.kind == "name" and not self.at("("):
                name = self.take().text
        if name is None:
            self.fns += 1
            name = f"<fn{self.fns}>"
        full = f"{owner}.{name}" if owner else name
        row = len(self.rows)
        self.add("func", t.at, fn=full, dst=self.var("%return", full), args=[], parts=[], field=name, text=f"function {name}")
        self.fn, self.cls = full, owner or held
        self.scopes.append(set())
        params: list[dict] = []
        if self.at("<"):
            self.skip_angle()
        if self.t.kind == "name" and not self.at("("):
            p = self.take().text
            self.scopes[-1].add(p)
            params.append({"var": self.var(p), "kind": "plain", "pos": 0, "name": p})
        else:
            self.take("(")
            while not self.accept(")"):
                while self.t.kind == "name" and (self.t.text in _MODIFIERS or self.t.text.startswith("@")) and self.peek() not in (",", ")", ":", "=", "?"):
                    self.i += 1
                    if self.at("("):
                        self.skip_group()
                rest = self.accept("...")
                at = self.t.at
                if self.at("{", "["):
                    v = self.var(f"%p{len(params)}")
                    self.pattern(v, at)
                    params.append({"var": v, "kind": "rest" if rest else "plain", "pos": len(params), "name": None})
                else:
                    p = self.take().text
                    self.scopes[-1].add(p)
                    params.append({"var": self.var(p), "kind": "rest" if rest else "plain", "pos": len(params), "name": p})
                self.accept("?")
                if self.accept(":"):
                    if self.t.kind == "name":
                        self.add("annotation", at, dst=params[-1]["var"], field=self.t.text, callee=self.known.get(f"{MODULE}|{self.t.text}"))
                    self.skip_type()
                if self.accept("="):
                    self.add("assign", at, dst=params[-1]["var"], src=self.assignment())
                self.accept(",")
        if self.accept(":"):
            self.skip_type()
        self.rows[row]["args"] = params
        if self.accept("=>"):
            if self.at("{"):
                self.block()
            else:
                self.add("return", self.t.at, src=self.assignment(), dst=self.var("%return"))
        elif self.at("{"):
            self.block()
        self.scopes.pop()
        self.fn, self.cls = outer, held
        return self.var(f"fn:{full}", MODULE)

    def klass(self) -> str:
        at = self.take("class").at
        name = self.take().text if self.t.kind == "name" and not self.at("extends", "implements") else f"<class{self.fns}>"
        bases: list[str] = []
        while not self.at("{"):
            t = self.take()
            if t.kind == "name" and t.text not in ("extends", "implements"):
                bases.append(self.api_of(t.text) or t.text)
            if t.text == "<":
                self.i -= 1
                self.skip_angle()
        self.add("class", at, field=name, parts=bases, text=f"class {name}")
        self.take("{")
        held, self.cls = self.cls, name
        while not self.accept("}"):
            if self.accept(";"):
                continue
            while self.t.kind == "name" and (self.t.text.startswith("@") or (self.t.text in _MODIFIERS and self.peek() not in ("(", "=", ":", ";", "?", "!", "<", "}"))):
                mark = self.t.text.startswith("@")
                self.i += 1
                if mark and self.at("("):
                    self.skip_group()
            self.accept("*")
            t = self.take()
            if t.text == "[":
                self.i -= 1
                self.skip_group()
            if t.text == "static" and self.at("{"):
                self.block()
                continue
            self.accept("?", "!")
            member = t.text.strip("'\"")
            if self.at("(", "<"):
                self.function(member, name)
                self.accept(";")
                continue
            if self.accept(":"):
                self.skip_type()
            if self.accept("="):
                if self.arrow_ahead():
                    self.function(member, name)
                else:
                    src = self.assignment()
                    self.add("assign", t.at, dst=self.attribute(name, member), src=src, field=member)
            self.accept(";")
        self.cls = held
        return self.var(f"class:{name}", MODULE)

    def attribute(self, cls: str, name: str) -> str:
        return f"{self.repo}|{self.path}|{cls}|.{name}"

    # ---- expressions: each returns a variable and leaves the API path in last_api
    last_api: str | None = None

    @staticmethod
    def joined(api: str, name: str) -> str:
        return f"{api}{name}" if api.endswith(":") else f"{api}.{name}"

    def expression(self) -> str:
        out = self.assignment()
        while self.accept(","):
            out = self.assignment()
        return out

    def assignment(self) -> str:
        if self.arrow_ahead():
            out = self.function()
            self.last_api = None
            return out
        if self.at("yield"):
            self.i += 1
            self.accept("*")
            return self.temp() if self.at(")", ";", "}", ",") else self.assignment()
        at = self.t.at
        if self.at("{", "[") and self.toks[self.match(self.i) + 1].text == "=":
            mark = self.i
            self.skip_group()
            self.take("=")
            src, api = self.assignment(), self.last_api
            after, self.i = self.i, mark
            self.pattern(src, at, api)
            self.i = after
            return src
        self.target: tuple | None = None
        left = self.ternary()
        target = self.target
        if self.t.kind == "punct" and self.t.text in _ASSIGN:
            op = self.take().text
            src, api = self.assignment(), self.last_api
            if op not in ("=", "??=", "||=", "&&="):
                both, src, api = src, self.temp(), None
                self.add("concat", at, dst=src, parts=[left, both])
            if target and target[0] == "name":
                if api and api not in ("undefined", "null"):
                    self.known[f"{self.fn}|{target[1]}"] = api
                self.add("assign", at, dst=self.place(target[1]), src=src)
            elif target and target[0] == "member":
                self.add("store", at, obj=target[1], field=target[2], src=src)
            elif target and target[0] == "this":
                self.add("assign", at, dst=self.attribute(self.cls or MODULE, target[1]), src=src, field=target[1])
            return src
        return left

    def ternary(self) -> str:
        left = self.binary(0)
        if not self.at("?"):
            return left
        at = self.take().at
        out = self.temp()
        for mark in (":", None):
            self.add("assign", at, dst=out, src=self.assignment())
            if mark:
                self.take(mark)
        self.last_api = self.target = None
        return out

    def binary(self, least: int) -> str:
        at, left = self.t.at, self.unary()
        while True:
            op = self.t.text if self.t.kind in ("punct", "name") else ""
            if op in ("as", "satisfies") and not self.t.line_break:
                self.i += 1
                self.accept("const") or self.skip_type()
                continue
            if op not in _BINARY or _BINARY[op] <= least:
                return left
            self.i += 1
            right = self.binary(_BINARY[op] - (op == "**"))
            api, out = self.last_api, self.temp()
            if op in ("??", "||", "&&"):
                for side in (left, right):
                    self.add("assign", at, dst=out, src=side)
            elif op not in _TESTS:
                self.add("concat", at, dst=out, parts=[left, right])
            self.last_api = api if op == "??" else None
            self.target = None
            left = out

    def unary(self) -> str:
        if self.at("!", "~", "+", "-", "++", "--") or (self.t.kind == "name" and self.t.text in ("typeof", "void", "delete")):
            op = self.take().text
            v = self.unary()
            self.last_api = None
            return self.temp() if op in ("!", "typeof", "void", "delete") else v
        if self.at("await"):
            self.i += 1
            return self.unary()
        if self.at("<") and self.toks[self.i + 1].kind in ("name", "punct"):
            return self.jsx()
        v = self.postfix(self.primary())
        self.accept("++", "--")
        return v

    def primary(self) -> str:
        t = self.take()
        self.last_api = self.target = None
        self.owner_this = False
        if t.kind in ("num", "regex"):
            return self.temp()
        if t.kind == "str":
            self.literal = "=" + t.text[1:-1]
            return self.temp()
        if t.kind == "tpl":
            return self.template(t)
        if t.text == "(":
            v = self.expression()
            self.take(")")
            return v
        if t.text == "[":
            out = self.temp()
            while not self.accept("]"):
                if not self.accept(","):
                    self.accept("...")
                    self.add("assign", self.t.at, dst=out, src=self.assignment())
            self.last_api = None
            return out
        if t.text == "{":
            return self.object(t)
        if t.text == "class":
            self.i -= 1
            return self.klass()
        if t.text == "new":
            return self.construct(t)
        if t.text == "this":
            self.owner_this = True
            return self.var("this", self.cls or MODULE)
        if t.text == "import" and self.at("("):
            self.skip_group()
            return self.temp()
        if t.kind != "name":
            raise Unreadable(f"unexpected {t.text}")
        if t.text == "require" and self.at("(") and self.toks[self.i + 1].kind == "str":
            self.last_api = self.toks[self.i + 1].text[1:-1] + ":"
            self.skip_group()
            return self.temp()
        self.last_api = self.api_of(t.text)
        self.target = ("name", t.text)
        self.name_at = t.at
        return self.place(t.text)

    def template(self, t: Token) -> str:
        out, parts = self.temp(), []
        for p in t.parts:
            if isinstance(p, tuple):
                held = self.toks, self.i
                self.toks, self.i = tokens(self.text, *p), 0
                if self.t.kind != "end":
                    parts.append(self.expression())
                self.toks, self.i = held
        self.literal = ("=" if len(t.parts) == 1 else "") + (t.parts[0] if t.parts else "")
        self.last_api = self.target = None
        if parts:
            self.add("concat", t.at, dst=out, parts=parts)
        return out

    literal: str | None = None

    def object(self, t: Token) -> str:
        out = self.temp()
        while not self.accept("}"):
            if self.accept("..."):
                self.add("assign", self.t.at, dst=out, src=self.assignment())
            else:
                while self.at("async", "get", "set", "*") and self.peek() not in (":", ",", "}", "("):
                    self.i += 1
                key = self.take()
                name = key.text.strip("'\"")
                if key.text == "[":
                    self.assignment()
                    self.take("]")
                    name = None
                if self.accept(":"):
                    src = self.assignment()
                elif self.at("("):
                    src = self.function(name)
                else:
                    src = self.place(name)
                    if self.accept("="):
                        self.assignment()
                self.add("store" if name else "assign", key.at, **({"obj": out, "field": name, "src": src} if name else {"dst": out, "src": src}))
            self.accept(",")
        self.last_api = self.target = None
        return out

    def construct(self, t: Token) -> str:
        name = self.t.text
        v = self.primary()
        while self.accept("."):
            name = self.take().text
            self.last_api = self.joined(self.last_api, name) if self.last_api else None
        if self.at("<"):
            self.skip_angle()
        api = self.last_api
        local = name in self.defined and not api
        args = self.arguments() if self.at("(") else []
        out = self.temp()
        self.add("call", t.at, dst=out, callee=f"{name}.constructor" if local else api, how="local" if local else "api" if api else "unknown", args=args, field=None, recv=None if api else v)
        self.last_api = f"{api}()" if api else None
        return out

    def arguments(self) -> list[dict]:
        self.take("(")
        out: list[dict] = []
        first = None
        while not self.accept(")"):
            spread = self.accept("...")
            self.literal = None
            head = self.t
            began = self.i
            v = self.assignment()
            if not out:
                known = self.literal if head.kind in ("str", "tpl") and self.literal is not None else ""
                first = known if self.i == began + 1 else known.lstrip("=")
            out.append({"var": v, "kind": "spread" if spread else "positional", "pos": len(out), "name": None})
            self.accept(",")
        self.first_literal = first
        return out

    def type_arguments(self) -> bool:
        """Whether type arguments of a call stand here; skips them."""
        mark = self.i
        try:
            for k in range(self.i, min(self.i + 40, len(self.toks))):
                if self.toks[k].text in (";", "&&", "||", "==", "===", "end"):
                    return False
                if self.toks[k].text == ">" and self.toks[k + 1].text == "(":
                    self.skip_angle()
                    if self.at("("):
                        return True
                    break
        except Unreadable:
            pass
        self.i = mark
        return False

    def postfix(self, v: str) -> str:
        start = self.toks[self.i - 1].at if self.target is None else self.name_at
        base_name = self.target[1] if self.target else None
        this, receiver, method = self.owner_this, None, None
        while True:
            if self.at(".", "?.") and self.toks[self.i + 1].kind == "name":
                self.i += 1
                name = self.take().text
                api = self.last_api
                receiver, method, holder = base_name, name, v
                base_name = name
                if this:
                    this = False
                    self.target = ("this", name)
                    if self.at("("):
                        v = self.call(start, v, None, "local", f"{self.cls or MODULE}.{name}", None)
                        receiver = method = None
                        continue
                    v, self.last_api = self.attribute(self.cls or MODULE, name), self.known.get(f"this|{self.cls}|{name}")
                    continue
                if api:
                    self.last_api = self.joined(api, name)
                    if self.at("(") or (self.at("<") and self.type_arguments()):
                        continue
                    out = self.temp()
                    self.add("load", start, dst=out, obj=holder, field=name, callee=api)
                    self.target, v = ("member", holder, name), out
                    continue
                if self.at("(", "?.") and (self.at("(") or self.peek() == "("):
                    self.target = None
                    v = self.call(start, holder, holder, "method", name, receiver)
                    continue
                out = self.temp()
                self.add("load", start, dst=out, obj=holder, field=name)
                self.target, v = ("member", holder, name), out
            elif self.at("[") or (self.at("?.") and self.peek() == "["):
                self.accept("?.")
                self.take("[")
                key = self.t.text[1:-1] if self.t.kind == "str" and self.peek() == "]" else None
                api = self.last_api
                if key is None:
                    self.expression()
                else:
                    self.i += 1
                self.take("]")
                out = self.temp()
                self.add("load" if key else "index", start, dst=out, **({"obj": v, "field": key, "callee": api} if key else {"src": v}))
                self.target, self.last_api, v, this = ("member", v, key) if key else None, None, out, False
            elif self.at("(") or (self.at("?.") and self.peek() == "("):
                self.accept("?.")
                api, local = self.last_api, base_name if method is None else None
                if local and local in self.defined and api is None:
                    v = self.call(start, v, None, "local", local, None)
                else:
                    v = self.call(start, v, None, "api" if api else "unknown", api, receiver, api)
                method = receiver = None
            elif self.at("<") and self.type_arguments():
                continue
            elif self.at("!") and not self.t.line_break and self.peek() not in ("=",):
                self.i += 1
            elif self.t.kind == "tpl" and not self.t.line_break:
                v = self.template(self.take())
            else:
                return v

    def call(self, start: int, v: str, recv: str | None, how: str, callee: str | None, receiver: str | None, api: str | None = None) -> str:
        self.accept("?.")
        args = self.arguments()
        url = self.first_literal if args else None
        out = self.temp()
        self.add("call", start, dst=out, callee=callee if callee else self.text[start : start + 40], how=how, recv=recv, args=args, field=receiver, host=url)
        self.last_api = f"{api}()" if api and api.count("()") < 8 else None
        self.target = None
        return out

    def jsx(self) -> str:
        """An element: what its expressions hold goes into it."""
        out, parts, at = self.temp(), [], self.t.at
        depth = 0
        while True:
            if self.accept("<"):
                closing = self.accept("/")
                depth += -1 if closing else 1
                while not self.at(">"):
                    if self.at("{"):
                        self.i += 1
                        self.accept("...")
                        if not self.at("}"):
                            parts.append(self.expression())
                        self.take("}")
                    elif self.at("/") and self.peek() == ">":
                        self.i += 1
                        depth -= 1
                    else:
                        self.take()
                self.take(">")
                if not depth:
                    break
            elif self.at("{"):
                self.i += 1
                if not self.at("}"):
                    parts.append(self.expression())
                self.take("}")
            else:
                self.take()
        if parts:
            self.add("concat", at, dst=out, parts=parts)
        self.last_api = self.target = None
        return out


def lower(repo: str, path: str, text: str) -> list[dict]:
    """Rows of one file."""
    try:
        return Reader(repo, path, text).run()
    except (Unreadable, RecursionError) as e:
        return [{"repo": repo, "path": path, "n": 0, "kind": "parse_error", "fn": MODULE, "text": str(e)[:80], "line": 1, "col": 1}]


def _run(batches):
    import pyarrow as pa

    arg = pa.struct([("var", pa.string()), ("kind", pa.string()), ("pos", pa.int32()), ("name", pa.string())])
    kinds = {"n": pa.int32(), "line": pa.int32(), "col": pa.int32(), "parts": pa.list_(pa.string()), "args": pa.list_(arg)}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in _FIELDS])
    return parsed(batches, schema, lower)


def lower_files(files: DataFrame) -> DataFrame:
    """Statements (see sources.python.IR) of files (path, text and, where there is one, repo)."""
    repo = F.col("repo") if "repo" in files.columns else F.lit("")
    return files.select(repo.alias("repo"), "path", "text").mapInArrow(_run, IR)
