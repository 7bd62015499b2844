"""C# files as declarations: usings, types and members, a row each.

A first pass over a file reads what it declares and not what its bodies do:
namespaces, types with their bases, fields, properties, methods with parameters,
and the attributes and modifiers of each. Executors read file by file; parts of
a type that stand in several files meet in `operators.program.merge_parts` and
in the joins of `operators.datasets`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parsed

DECLARATIONS = (
    "repo string, path string, kind string, namespace string, owner string, name string, fqn string, type string, bases array<string>, "
    "modifiers array<string>, attributes array<string>, parameters array<struct<type:string,name:string>>, line int"
)
_FIELDS = [c.strip().split(" ")[0] for c in "repo,path,kind,namespace,owner,name,fqn,type,bases,modifiers,attributes,parameters,line".split(",")]
#: The language's modifiers and the words that begin a type.
MODIFIERS = frozenset("public private protected internal static abstract sealed virtual override readonly async partial extern new unsafe volatile required const file ref event implicit explicit".split())
TYPES = frozenset(("class", "struct", "interface", "record", "enum"))
_TOKEN = re.compile(
    r'(?:(?<=\S) )?(?:(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^[ \t]*\#[^\n]*)|(?P<text>\$*"""(?:.*?)"""|[$@]*@[$@]*"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\])+\')|(?P<name>@?[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<sign>=>|::|\?\?=?|[^\s\w])|(?P<bad>.))',
    re.S | re.M,
)
_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = frozenset(_OPEN.values())


class Unreadable(ValueError):
    """The file isn't what this reader understands."""


class Reader:
    def __init__(self, repo: str, path: str, text: str):
        self.base = {"repo": repo, "path": path}
        self.toks: list[tuple[str, str, int]] = []
        line, add = 1, self.toks.append
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            said = m[kind]
            if kind == "sign" or kind == "num":
                add((kind, said, line))
            elif kind == "name":
                add((kind, said.lstrip("@"), line))
            elif kind == "bad":
                raise Unreadable(f"line {line}: {text[m.start() : m.start() + 10]!r}")
            else:
                if kind == "text":
                    add((kind, said, line))
                line += said.count("\n")
        self.toks.append(("end", "", line))
        self.i, self.rows = 0, []

    # ---- tokens
    @property
    def t(self) -> str:
        return self.toks[self.i][1]

    @property
    def kind(self) -> str:
        return self.toks[self.i][0]

    def take(self, want: str | None = None) -> str:
        kind, text, line = self.toks[self.i]
        if kind == "end" or want is not None and text != want:
            raise Unreadable(f"line {line}: {want or 'more'} expected, {text!r} found")
        self.i += 1
        return text

    def group(self) -> list[str]:
        """Tokens of a bracketed group, the outer brackets left out."""
        close, start, toks = [_OPEN[self.take()]], self.i, self.toks
        while close:
            kind, x, line = toks[self.i]
            if kind == "sign":
                if x in _OPEN:
                    close.append(_OPEN[x])
                elif x == close[-1]:
                    close.pop()
                elif x in _CLOSE:
                    self.i += 1
                    raise Unreadable(f"line {line}: {close[-1]} expected")
            elif kind == "end":
                self.take()
            self.i += 1
        return [x for _, x, _ in toks[start : self.i - 1]]

    def until(self, *stops: str) -> list[str]:
        """Tokens up to one of the stops outside brackets and type arguments; the stop stays."""
        out, depth, toks = [], 0, self.toks
        while True:
            kind, text, _ = toks[self.i]
            if kind == "end":
                break
            if kind == "sign":
                if not depth and text in stops:
                    return out
                if text in _OPEN:
                    start = self.i
                    self.group()
                    out += [x for _, x, _ in toks[start : self.i]]
                    continue
                depth += (text == "<") - (text == ">" and depth > 0)
            out.append(text)
            self.i += 1
        raise Unreadable("the file ends within a declaration")

    # ---- declarations
    def add(self, kind: str, line: int, namespace: str, owner: str | None, name: str, **more) -> None:
        fqn = ".".join(x for x in (namespace, owner, name) if x)
        self.rows.append(self.base | {"kind": kind, "namespace": namespace, "owner": owner, "name": name, "fqn": fqn, "line": line, "bases": [], "modifiers": [], "attributes": [], "parameters": []} | more)

    def run(self) -> list[dict]:
        self.scope("")
        return self.rows

    def scope(self, namespace: str) -> None:
        """A file's or a namespace's body."""
        while self.kind != "end" and self.t != "}":
            line = self.toks[self.i][2]
            if self.t in ("using", "global") and self.toks[self.i + 1][1] != "(":
                words = self.until(";", "{")
                self.take()
                target = _joined([w for w in words if w not in ("using", "global", "static")])
                self.add("using", line, namespace, None, target.split("=")[-1], type=target.split("=")[0] if "=" in target else None)
            elif self.t == "namespace":
                self.take()
                inner = ".".join(x for x in (namespace, _joined(self.until(";", "{"))) if x)
                if self.take() == ";":
                    namespace = inner
                else:
                    self.scope(inner)
                    self.take("}")
            elif self.t == ";":
                self.take()
            else:
                self.declaration(namespace, None)

    def declaration(self, namespace: str, owner: str | None) -> None:
        """A type, or within a type a member."""
        line, attributes, modifiers = self.toks[self.i][2], [], []
        while self.t == "[" and self.kind == "sign":
            attributes += _attributes(self.group())
        while self.t in MODIFIERS and self.kind == "name" and not (self.t in ("record", "file", "required") and self.toks[self.i + 1][1] in ("=", ";", "(")):
            modifiers.append(self.take())
        marks = {"modifiers": modifiers, "attributes": attributes}
        if self.kind == "name" and self.t in TYPES and self.toks[self.i + 1][0] == "name":
            return self.type(line, namespace, owner, marks)
        if self.t == "delegate":
            self.until(";")
            self.take(";")
            return None
        if owner is None:
            self.until(";", "{")
            return self.body()
        words = self.until("(", "{", ";", "=", "=>")
        if self.t == "(" and (not words or words[-1] in ("operator", "this")):
            words = [*words, *self.until("{", ";", "=>")]
        if words and words[-1] == ">" and self.t == "(":
            words = words[: _opening(words, "<", ">")]
        if "this" in words and words[-1] == "]":
            words = [*words[: words.index("this")], "this[]"]
        name = words[-1] if words else ""
        of = _joined(words[:-1])
        if self.t == "(":
            marks["parameters"] = _parameters(self.group())
            self.add("method", line, namespace, owner, name or owner.split(".")[-1], type=of or None, **marks)
            if self.t == ":" or self.t == "where":
                self.until("{", ";", "=>")
            return self.body()
        self.add("property" if self.t in ("{", "=>") else "field", line, namespace, owner, name, type=of or None, **marks)
        if self.t == "{":
            self.group()
            if self.t == "=" and self.kind == "sign":
                self.until(";")
                self.take(";")
            return None
        return self.body()

    def body(self) -> None:
        """What follows a head: a block, an expression, or nothing."""
        if self.t == "{":
            self.group()
        else:
            self.until(";")
            self.take(";")

    def type(self, line: int, namespace: str, owner: str | None, marks: dict) -> None:
        keyword = self.take()
        if keyword == "record" and self.t in ("class", "struct"):
            self.take()
        name = self.take()
        head = self.until("{", ";", "(", ":")
        parameters = _parameters(self.group()) if self.t == "(" else []
        bases = []
        self.until("{", ";", ":")
        if self.t == ":":
            self.take()
            listed = self.until("{", ";")
            if "where" in listed:
                listed = listed[: listed.index("where")]
            bases = [_joined(_without_arguments(b)) for b in _split(listed)]
        inner = f"{owner}.{name}" if owner else name
        self.add(keyword, line, namespace, owner, name, type=_joined(head) or None, bases=bases, parameters=parameters, **marks)
        if keyword == "record":
            for p in parameters:
                self.add("property", line, namespace, inner, p["name"], type=p["type"])
        if self.take() == ";":
            return
        if keyword == "enum":
            self.i -= 1
            self.group()
            return
        while self.t != "}":
            if self.t == ";":
                self.take()
            else:
                self.declaration(namespace, inner)
        self.take("}")


def _joined(words: list[str]) -> str:
    """Tokens as text: a space only between two words."""
    if len(words) == 1 and words[0].isalnum():
        return words[0]
    return re.sub(r"(?<=\w) (?=\w)|\s+", lambda m: " " if m[0] == " " and m.string[m.start() - 1].isalnum() and m.string[m.end()].isalnum() else "", " ".join(words))


def _split(words: list[str]) -> list[list[str]]:
    """Parts between commas outside brackets and type arguments."""
    out, depth = [[]], 0
    for w in words:
        depth += (w in "([{<") - (w in ")]}>") if len(w) == 1 else 0
        if w == "," and depth <= 0:
            out.append([])
        else:
            out[-1].append(w)
    return [x for x in out if x]


def _opening(words: list[str], opens: str, closes: str) -> int:
    """Where the group that ends the words begins."""
    depth = 0
    for k in range(len(words) - 1, -1, -1):
        depth += (words[k] == closes) - (words[k] == opens)
        if not depth:
            return k
    raise Unreadable(f"{opens} expected")


def _without_arguments(words: list[str]) -> list[str]:
    """A base without the arguments handed to its constructor."""
    return words[: words.index("(")] if "(" in words else words


def _attributes(words: list[str]) -> list[str]:
    """Names of the attributes of one bracketed list, targets and arguments left out."""
    return [_joined(_without_arguments(a[a.index(":") + 1 :] if ":" in a[:2] else a)) for a in _split(words)]


def _parameters(words: list[str]) -> list[dict]:
    out = []
    for p in _split(words):
        while p and p[0] == "[":
            p = p[p.index("]") + 1 :]
        p = p[: p.index("=")] if "=" in p else p
        while p and p[0] in ("this", "ref", "out", "in", "params", "scoped", "readonly"):
            p = p[1:]
        if len(p) > 1:
            out.append({"type": _joined(p[:-1]), "name": p[-1]})
    return out


def declare(repo: str, path: str, text: str) -> list[dict]:
    """Rows of one file; one that can't be read gives one `parse_error` row."""
    try:
        return Reader(repo, path, text).run()
    except (Unreadable, RecursionError, ValueError, IndexError) as e:
        return [{"repo": repo, "path": path, "kind": "parse_error", "name": str(e)[:80], "line": 1}]


def _run(batches):
    import pyarrow as pa

    lists = pa.list_(pa.string())
    kinds = {"bases": lists, "modifiers": lists, "attributes": lists, "parameters": pa.list_(pa.struct([("type", pa.string()), ("name", pa.string())])), "line": pa.int32()}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in _FIELDS])
    return parsed(batches, schema, declare)


def declarations(files: DataFrame) -> DataFrame:
    """Declarations (see DECLARATIONS) of files (path, text and, where there is one, repo)."""
    repo = F.col("repo") if "repo" in files.columns else F.lit("")
    return files.select(repo.alias("repo"), "path", "text").mapInArrow(_run, DECLARATIONS)
