"""Python programs as relations: one row a statement, by the standard library's parser.

Executors parse files independently (a narrow stage; a file's rows never meet
another's). Names are resolved to API paths where the file's own imports and
assignments say so; what crosses files is left to joins.
"""

from __future__ import annotations

import ast
import builtins
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parsed

IR = (
    "repo string, path string, n int, kind string, fn string, dst string, src string, obj string, field string, parts array<string>, "
    "callee string, how string, recv string, args array<struct<var:string,kind:string,pos:int,name:string>>, host string, text string, line int, col int"
)
_FIELDS = [c.strip().split(" ")[0] for c in "repo,path,n,kind,fn,dst,src,obj,field,parts,callee,how,recv,args,host,text,line,col".split(",")]
MODULE = "<module>"


class Lowering(ast.NodeVisitor):
    """Rows of one file. A variable is `repo|path|function|name`; a class attribute `repo|path|Class|.name`."""

    def __init__(self, repo: str, path: str, text: str):
        self.repo, self.path, self.rows, self.n = repo, path, [], 0
        self.base = f"{repo}|{path}|"
        self.lines = re.split(r"\r\n?|\n", text) if "\r" in text else text.split("\n")
        self.plain = text.isascii()
        self.fn, self.cls, self.scope = MODULE, None, [{}]
        self.known: dict[str, str] = {}
        self.local: dict[str, bool] = {}

    # ---- names
    def var(self, name: str, fn: str | None = None) -> str:
        return f"{self.base}{fn or self.fn}|{name}"

    def temp(self) -> str:
        self.n += 1
        return self.var(f"%{self.n}")

    def cite(self, node: ast.AST) -> str:
        """The text of a node, its lines and spaces as one; lines after the first 80 characters aren't looked at."""
        last = getattr(node, "end_lineno", None)
        if last is None:
            return ""
        line, start, end = node.lineno, node.col_offset, node.end_col_offset
        if line == last:
            got = " ".join(self.cut(line, start, end).split())
        else:
            got = " ".join(self.cut(line, start, None).split())
            while line < last and len(got) <= 80:
                line += 1
                got = " ".join([got, *self.cut(line, 0, end if line == last else None).split()]).strip()
        return got if len(got) <= 80 else got[:79] + "…"

    def cut(self, line: int, start: int, end: int | None) -> str:
        """A stretch of a line; the parser counts bytes."""
        text = self.lines[line - 1]
        return text[start:end] if self.plain else text.encode()[start:end].decode()

    def add(self, kind: str, node: ast.AST, text: str | None = None, **more) -> None:
        row = {"repo": self.repo, "path": self.path, "n": len(self.rows), "kind": kind, "fn": self.fn, "text": self.cite(node) if text is None else text, "line": getattr(node, "lineno", 1), "col": getattr(node, "col_offset", 0) + 1}
        row.update(more)
        self.rows.append(row)

    def api(self, node: ast.AST) -> str | None:
        """The API path of an expression, if the file tells."""
        if isinstance(node, ast.Name):
            return self.known.get(f"{self.fn}|{node.id}") or self.known.get(f"{MODULE}|{node.id}") or (f"builtins.{node.id}" if hasattr(builtins, node.id) and node.id not in self.local else None)
        if isinstance(node, ast.Attribute):
            base = self.api(node.value)
            return f"{base}.{node.attr}" if base else None
        if isinstance(node, ast.Call):
            base = self.api(node.func)
            return f"{base}()" if base and base.count("()") < 8 else None
        if isinstance(node, ast.Await):
            return self.api(node.value)
        return None

    def place(self, name: str) -> str:
        """The variable a name reads: the function's own, else the module's."""
        return self.var(name) if name in self.scope[-1] or self.fn == MODULE else self.var(name, MODULE)

    # ---- statements
    def run(self, tree: ast.Module) -> list[dict]:
        self.local = dict.fromkeys(_defined(tree.body), True)
        self.block(tree.body)
        return self.rows

    def block(self, body: list[ast.stmt]) -> None:
        for s in body:
            self.visit(s)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            name = a.asname or a.name.split(".")[0]
            self.known[f"{self.fn}|{name}"] = a.name if a.asname else name
            self.add("import", node, callee=a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        for a in node.names:
            self.known[f"{self.fn}|{a.asname or a.name}"] = f"{base}.{a.name}" if base.strip(".") else base + a.name
        self.add("import", node, callee=base)

    def visit_FunctionDef(self, node) -> None:
        outer, name = self.fn, (f"{self.cls}.{node.name}" if self.cls else node.name)
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        skip = 1 if self.cls and plain and plain[0].arg in ("self", "cls") else 0
        params = [{"var": self.var(p.arg, name), "kind": "plain", "pos": k - skip, "name": p.arg} for k, p in enumerate(plain) if k >= skip]
        params += [{"var": self.var(p.arg, name), "kind": "plain", "pos": None, "name": p.arg} for p in a.kwonlyargs]
        if a.vararg:
            params.append({"var": self.var(a.vararg.arg, name), "kind": "rest", "pos": len(plain) - skip, "name": None})
        if a.kwarg:
            params.append({"var": self.var(a.kwarg.arg, name), "kind": "kwrest", "pos": None, "name": None})
        marks = [self.api(d.func if isinstance(d, ast.Call) else d) or "" for d in node.decorator_list]
        self.add("func", node, fn=name, dst=self.var("%return", name), args=params, parts=marks, field=node.name, text=f"def {node.name}")
        for p in [*plain[skip:], *a.kwonlyargs]:
            if p.annotation is not None:
                self.add("annotation", p, fn=name, dst=self.var(p.arg, name), field=_type_name(p.annotation), callee=self.api(p.annotation))
        self.fn = name
        self.scope.append({p.arg: 1 for p in [*plain, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]} | dict.fromkeys(_stored(node.body), 1))
        held, self.cls = self.cls, None
        self.owner = getattr(self, "owner", None) if held is None else held
        self.block(node.body)
        self.scope.pop()
        self.fn, self.cls = outer, held

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("class", node, field=node.name, parts=[self.api(b) or getattr(b, "id", "") for b in node.bases], text=f"class {node.name}")
        held, self.cls = self.cls, node.name
        self.block(node.body)
        self.cls = held

    def visit_Return(self, node: ast.Return) -> None:
        if node.value:
            self.add("return", node, src=self.value(node.value), dst=self.var("%return"))

    def visit_Raise(self, node: ast.Raise) -> None:
        if node.exc:
            self.add("throw", node, src=self.value(node.exc), dst=self.var("%throw"))

    def member(self, node: ast.stmt, target: ast.expr, made: ast.expr | None) -> None:
        """A class's attribute, with what it is made or annotated by."""
        if self.cls and self.fn == MODULE and isinstance(target, ast.Name):
            at = made.func if isinstance(made, ast.Call) else made
            self.add("member", node, obj=self.cls, field=target.id, callee=self.api(at) if at else None)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.member(node, node.targets[0], node.value)
        src, path = self.value(node.value), self.api(node.value)
        for t in node.targets:
            self.store(t, src, node, path)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.member(node, node.target, node.value or node.annotation)
        if node.value:
            self.store(node.target, self.value(node.value), node, self.api(node.value))

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        src = self.value(node.value)
        if isinstance(node.target, ast.Name):
            self.add("concat", node, dst=self.place(node.target.id), parts=[src, self.place(node.target.id)])
        else:
            self.store(node.target, src, node, None)

    def visit_For(self, node) -> None:
        self.store(node.target, self.value(node.iter), node, None, kind="iterate")
        self.block([*node.body, *node.orelse])

    visit_AsyncFor = visit_For

    def visit_With(self, node) -> None:
        for i in node.items:
            v = self.value(i.context_expr)
            if i.optional_vars:
                self.store(i.optional_vars, v, i.context_expr, self.api(i.context_expr))
        self.block(node.body)

    visit_AsyncWith = visit_With

    def visit_If(self, node) -> None:
        self.value(node.test)
        self.block([*node.body, *node.orelse])

    visit_While = visit_If

    def visit_Try(self, node) -> None:
        self.block(node.body)
        for h in node.handlers:
            if h.name:
                self.add("assign", h, src=self.var("%throw"), dst=self.var(h.name), text=f"except {h.name}")
            self.block(h.body)
        self.block([*node.orelse, *node.finalbody])

    visit_TryStar = visit_Try

    def visit_Match(self, node: ast.Match) -> None:
        self.value(node.subject)
        for c in node.cases:
            self.block(c.body)

    def visit_Expr(self, node: ast.Expr) -> None:
        self.value(node.value)

    def generic_visit(self, node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.expr):
                self.value(child)

    def store(self, target: ast.expr, src: str, node: ast.AST, path: str | None, kind: str = "assign") -> None:
        if isinstance(target, ast.Name):
            if path and not path.startswith("builtins."):
                self.known[f"{self.fn}|{target.id}"] = path
            self.add(kind, node, dst=self.place(target.id), src=src)
        elif isinstance(target, ast.Attribute):
            if isinstance(target.value, ast.Name) and target.value.id == "self" and getattr(self, "owner", None):
                self.add("assign", node, dst=f"{self.repo}|{self.path}|{self.owner}|.{target.attr}", src=src, field=target.attr)
            else:
                self.add("store", node, obj=self.value(target.value), field=target.attr, src=src)
        elif isinstance(target, ast.Subscript):
            key = target.slice.value if isinstance(target.slice, ast.Constant) and isinstance(target.slice.value, str) else None
            obj = self.value(target.value)
            self.add("store" if key else "assign", node, **({"obj": obj, "field": key, "src": src} if key else {"dst": obj, "src": src}))
        elif isinstance(target, ast.Tuple | ast.List):
            for e in target.elts:
                self.store(e.value if isinstance(e, ast.Starred) else e, src, node, None, "iterate")

    # ---- expressions
    def value(self, node: ast.expr) -> str:
        """The variable that holds an expression's value."""
        f = _VALUES.get(type(node))
        if f:
            return f(self, node)
        out = self.temp()
        parts = [self.value(c) for c in ast.iter_child_nodes(node) if isinstance(c, ast.expr)]
        if parts:
            self.add("concat", node, dst=out, parts=parts)
        return out

    def value_Name(self, node: ast.Name) -> str:
        return self.place(node.id)

    def value_Constant(self, node: ast.Constant) -> str:
        return self.temp()

    def value_Compare(self, node: ast.Compare) -> str:
        for c in [node.left, *node.comparators]:
            self.value(c)
        return self.temp()

    def value_Lambda(self, node: ast.Lambda) -> str:
        return self.value(node.body)

    def value_NamedExpr(self, node: ast.NamedExpr) -> str:
        src = self.value(node.value)
        self.store(node.target, src, node, self.api(node.value))
        return src

    def value_Await(self, node: ast.Await) -> str:
        return self.value(node.value)

    def value_IfExp(self, node: ast.IfExp) -> str:
        self.value(node.test)
        out = self.temp()
        for x in (node.body, node.orelse):
            self.add("assign", x, dst=out, src=self.value(x))
        return out

    def value_BoolOp(self, node: ast.BoolOp) -> str:
        out = self.temp()
        for x in node.values:
            self.add("assign", x, dst=out, src=self.value(x))
        return out

    def comprehension(self, node, elements: list[ast.expr]) -> str:
        for g in node.generators:
            self.store(g.target, self.value(g.iter), g.iter, None, "iterate")
            for c in g.ifs:
                self.value(c)
        out = self.temp()
        self.add("concat", node, dst=out, parts=[self.value(e) for e in elements])
        return out

    def value_ListComp(self, node) -> str:
        return self.comprehension(node, [node.elt])

    value_SetComp = value_GeneratorExp = value_ListComp

    def value_DictComp(self, node) -> str:
        return self.comprehension(node, [node.key, node.value])

    def value_Dict(self, node: ast.Dict) -> str:
        out = self.temp()
        for k, v in zip(node.keys, node.values, strict=True):
            src = self.value(v)
            if isinstance(k, ast.Constant) and isinstance(k.value, str):
                self.add("store", v, obj=out, field=k.value, src=src)
            else:
                self.add("assign", v, dst=out, src=src)
        return out

    def read(self, node: ast.expr, obj: ast.expr, field: str) -> str:
        out, path = self.temp(), self.api(obj)
        self.add("load", node, dst=out, obj=self.value(obj), field=field, callee=path)
        return out

    def value_Attribute(self, node: ast.Attribute) -> str:
        if isinstance(node.value, ast.Name) and node.value.id == "self" and getattr(self, "owner", None):
            return f"{self.repo}|{self.path}|{self.owner}|.{node.attr}"
        path = self.api(node)
        if path:
            out = self.temp()
            self.add("api", node, dst=out, callee=path, field=node.attr)
            return out
        return self.read(node, node.value, node.attr)

    def value_Subscript(self, node: ast.Subscript) -> str:
        if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            return self.read(node, node.value, node.slice.value)
        out = self.temp()
        self.add("index", node, dst=out, src=self.value(node.value))
        self.value(node.slice) if isinstance(node.slice, ast.expr) else None
        return out

    def value_Call(self, node: ast.Call) -> str:
        f = node.func
        if isinstance(f, ast.Attribute) and f.attr in ("get", "pop", "getlist") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) and not (self.api(f.value) or "").startswith(("requests", "httpx")):
            return self.read(node, f.value, node.args[0].value)
        args = []
        for k, a in enumerate(node.args):
            args.append({"var": self.value(a.value if isinstance(a, ast.Starred) else a), "kind": "spread" if isinstance(a, ast.Starred) else "positional", "pos": k, "name": None})
        for w in node.keywords:
            args.append({"var": self.value(w.value), "kind": "keyword" if w.arg else "kwspread", "pos": None, "name": w.arg})
        path, recv = self.api(f), None
        how = "api" if path else "unknown"
        callee = path
        if isinstance(f, ast.Name) and f.id in self.local:
            how, callee = "local", f.id
        elif isinstance(f, ast.Attribute):
            if isinstance(f.value, ast.Name) and f.value.id == "self" and getattr(self, "owner", None):
                how, callee = "local", f"{self.owner}.{f.attr}"
            elif not path:
                how, callee, recv = "method", f.attr, self.value(f.value)
        elif not path:
            callee = self.cite(f)
        out = self.temp()
        self.add("call", node, dst=out, callee=callee, how=how, recv=recv, args=args, field=self.receiver(f), host=self.url(node))
        return out

    @staticmethod
    def receiver(f: ast.expr) -> str | None:
        v = f.value if isinstance(f, ast.Attribute) else None
        return v.id if isinstance(v, ast.Name) else v.attr if isinstance(v, ast.Attribute) else None

    def url(self, node: ast.Call) -> str | None:
        """The known start of the first argument or `url`, with `=` before it where it is complete."""
        first = next((w.value for w in node.keywords if w.arg == "url"), node.args[0] if node.args else None)
        if isinstance(first, ast.Constant) and isinstance(first.value, str):
            return "=" + first.value
        if isinstance(first, ast.JoinedStr):
            head = first.values[0] if first.values else None
            return head.value if isinstance(head, ast.Constant) else ""
        if isinstance(first, ast.BinOp) and isinstance(first.left, ast.Constant) and isinstance(first.left.value, str):
            return first.left.value
        return None if first is None else ""


#: How each kind of expression is lowered, by its class.
_VALUES = {getattr(ast, name.removeprefix("value_")): f for name, f in vars(Lowering).items() if name.startswith("value_")}
_BLOCKS = ("body", "orelse", "finalbody", "handlers", "cases")


def _defined(body: list[ast.stmt]) -> list[str]:
    """Names of all functions and classes among statements, nested ones too; expressions hold none."""
    out, todo = [], list(body)
    while todo:
        node = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append(node.name)
        for field in _BLOCKS:
            todo += getattr(node, field, ())
    return out


def _stored(body: list[ast.stmt]) -> list[str]:
    """Names that statements store to, nested ones too."""
    out, todo = [], list(body)
    while todo:
        node = todo.pop()
        kind = type(node)
        if kind is ast.Name:
            if type(node.ctx) is ast.Store:
                out.append(node.id)
        elif kind is not ast.Constant:
            for field in node._fields:
                held = getattr(node, field, None)
                if isinstance(held, ast.AST):
                    todo.append(held)
                elif isinstance(held, list):
                    todo += [x for x in held if isinstance(x, ast.AST)]
    return out


def _type_name(node: ast.AST) -> str | None:
    """The simple name of an annotation: of `a.B`, `"B"`, `Optional[B]`, `B | None` and `Annotated[B, ...]` it is B."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value.split("[")[0].split(".")[-1].strip() or None
    if isinstance(node, ast.BinOp):
        return _type_name(node.left) or _type_name(node.right)
    if isinstance(node, ast.Subscript):
        inner = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) and node.slice.elts else node.slice
        return _type_name(inner) if _type_name(node.value) in ("Optional", "Annotated", "List", "list", "Sequence", "Iterable", "Union") else _type_name(node.value)
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def lower(repo: str, path: str, text: str) -> list[dict]:
    """Rows of one file; a file that doesn't parse gives one `parse_error` row."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"repo": repo, "path": path, "n": 0, "kind": "parse_error", "fn": MODULE, "text": str(getattr(e, "msg", e))[:80], "line": getattr(e, "lineno", None) or 1, "col": 1}]
    return Lowering(repo, path, text).run(tree)


def _run(batches, kinds_of=None):
    import pyarrow as pa

    arg = pa.struct([("var", pa.string()), ("kind", pa.string()), ("pos", pa.int32()), ("name", pa.string())])
    kinds = {"n": pa.int32(), "line": pa.int32(), "col": pa.int32(), "parts": pa.list_(pa.string()), "args": pa.list_(arg)}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in _FIELDS])
    read = lower if kinds_of is None else lambda *file: [r for r in lower(*file) if r["kind"] in kinds_of]
    return parsed(batches, schema, read)


def lower_files(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Statements (see IR) of files (path, text and, where there is one, repo), of these kinds or all.

    Files are read whole whatever the kinds; rows of others just don't leave the reader.
    """
    repo = F.col("repo") if "repo" in files.columns else F.lit("")
    wanted = None if kinds is None else frozenset(kinds)
    return files.select(repo.alias("repo"), "path", "text").mapInArrow(lambda batches: _run(batches, wanted), IR)
