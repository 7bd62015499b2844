"""Project files as rows: packages, compiler settings, C# projects, compose services and Prisma schemas.

Each file is read on its own by an executor and gives (repo, path, root, kind,
name, value) rows; what spans files (extends chains, nearest projects) is left
to joins. A file that can't be read gives one `unreadable` row.
"""

from __future__ import annotations

import json
import re
import tomllib
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "repo string, path string, root string, kind string, name string, value string"
_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.S)
_TRAILING = re.compile(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])')
_BLOCK = re.compile(r"^\s*(model|type|enum|view)\s+(\w+)\s*\{(.*?)^\s*\}", re.S | re.M)
_SERVICE = re.compile(r"^(\s+)([\w.-]+):\s*$")


def jsonc(text: str):
    text = _COMMENT.sub(lambda m: m[1] or "", text.lstrip("﻿"))
    return json.loads(_TRAILING.sub(lambda m: m[1] or m[2], text))


def package(text: str) -> list[tuple[str, str, str]]:
    doc = json.loads(text)
    rows = [("package", "name", doc.get("name") or ""), *(("script", k, str(v)) for k, v in doc.get("scripts", {}).items())]
    for group in ("dependencies", "devDependencies", "peerDependencies"):
        rows += [("dependency", k, str(v)) for k, v in doc.get(group, {}).items()]
    spaces = doc.get("workspaces", [])
    return rows + [("workspace", w, "") for w in (spaces.get("packages", []) if isinstance(spaces, dict) else spaces)]


def tsconfig(text: str) -> list[tuple[str, str, str]]:
    doc = jsonc(text)
    options = doc.get("compilerOptions", {})
    extends = doc.get("extends", [])
    rows = [("extends", e, "") for e in ([extends] if isinstance(extends, str) else extends)]
    rows += [("base_url", "", options["baseUrl"])] if "baseUrl" in options else []
    return rows + [("alias", k, v) for k, vs in options.get("paths", {}).items() for v in vs]


def pyproject(text: str) -> list[tuple[str, str, str]]:
    doc = tomllib.loads(text)
    project, poetry = doc.get("project", {}), doc.get("tool", {}).get("poetry", {})
    rows = [("package", "name", project.get("name") or poetry.get("name") or "")]
    rows += [("dependency", m[0].lower(), d) for d in project.get("dependencies", []) if (m := re.match(r"[\w.-]+", d))]
    return rows + [("dependency", k.lower(), str(v)) for k, v in poetry.get("dependencies", {}).items()]


def requirements(text: str) -> list[tuple[str, str, str]]:
    lines = (line.split("#")[0].strip() for line in text.split("\n"))
    return [("dependency", m[0].lower(), line) for line in lines if line and line[0] != "-" and (m := re.match(r"[\w.-]+", line))]


def csproj(text: str) -> list[tuple[str, str, str]]:
    tree = ElementTree.fromstring(text.lstrip("﻿"))
    rows = [("sdk", "", tree.get("Sdk") or "")]
    for e in tree.iter():
        tag = e.tag.rpartition("}")[2]
        if tag in ("ProjectReference", "PackageReference", "Using", "FrameworkReference") and (what := e.get("Include")):
            rows.append((tag, what.replace("\\", "/"), e.get("Version") or ""))
        elif tag in ("RootNamespace", "AssemblyName", "OutputType", "TargetFramework", "ImplicitUsings") and e.text:
            rows.append(("property", tag, e.text.strip()))
    return rows


def prisma(text: str) -> list[tuple[str, str, str]]:
    """Models, types and enums; a field's value is its type and attributes."""
    rows = []
    for kind, name, body in _BLOCK.findall(re.sub(r"//[^\n]*", "", text)):
        mapped = re.search(r'@@map\("([^"]*)"\)', body)
        rows.append((kind, name, mapped[1] if mapped else name))
        if kind != "enum":
            for line in body.split("\n"):
                if m := re.match(r"\s*(\w+)\s+([\w.]+(?:\[\]|\?)?)\s*(.*)", line):
                    column = re.search(r'@map\("([^"]*)"\)', m[3])
                    rows.append(("field", f"{name}.{column[1] if column else m[1]}", f"{m[2]} {m[3]}".strip()))
    return rows


def compose(text: str) -> list[tuple[str, str, str]]:
    """Services with their images, build contexts and environment, by indentation."""
    rows: list[tuple[str, str, str]] = []
    inside, step, service, block = False, None, None, None
    for line in text.split("\n"):
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        indent = len(bare) - len(bare.lstrip())
        if indent == 0:
            inside, step, service = bare.startswith("services:"), None, None
            continue
        if not inside:
            continue
        step = indent if step is None else step
        if indent == step and (m := _SERVICE.match(bare)):
            service, block = m[2], None
            rows.append(("service", service, ""))
        elif service and (m := re.match(r"\s+(image|build|container_name|context):\s*(.*)", bare)):
            block = m[1]
            if m[2]:
                rows.append((("context" if m[1] == "build" else m[1]), service, m[2].strip("'\"")))
        elif service and (m := re.match(r"\s+(environment|depends_on|ports):", bare)):
            block = m[1]
        elif service and block == "environment" and (m := re.match(r"\s+-?\s*['\"]?([\w.:]+)\s*[:=]\s*(.*?)['\"]?$", bare)):
            rows.append(("environment", f"{service}.{m[1]}", m[2].strip("'\"")))
        elif service and block == "depends_on" and (m := re.match(r"\s+-?\s*([\w.-]+):?$", bare)):
            rows.append(("depends_on", service, m[1]))
    return rows


#: File names and what reads them.
READERS = (
    (re.compile(r"(?:^|/)package\.json$"), package),
    (re.compile(r"(?:^|/)[tj]sconfig[^/]*\.json$"), tsconfig),
    (re.compile(r"(?:^|/)pyproject\.toml$"), pyproject),
    (re.compile(r"(?:^|/)requirements[^/]*\.txt$"), requirements),
    (re.compile(r"\.(?:csproj|props)$"), csproj),
    (re.compile(r"\.prisma$"), prisma),
    (re.compile(r"(?:^|/)(?:docker-)?compose[^/]*\.ya?ml$"), compose),
)
WANTED = "|".join(f"(?:{r.pattern})" for r, _ in READERS)


def read(path: str, text: str) -> list[tuple[str, str, str]]:
    for pattern, reader in READERS:
        if pattern.search(path):
            try:
                return reader(text)
            except (ValueError, KeyError, AttributeError, TypeError, ElementTree.ParseError) as e:
                return [("unreadable", type(e).__name__, str(e)[:80])]
    return []


def _run(batches):
    import pyarrow as pa

    names = ["repo", "path", "root", "kind", "name", "value"]
    for b in batches:
        rows = []
        for repo, path, text in zip(*[b.column(c).to_pylist() for c in ("repo", "path", "text")], strict=True):
            root = path.rpartition("/")[0]
            rows += [(repo, path, root, *r) for r in read(path, text or "")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(6)], names)


def manifest_rows(files: DataFrame) -> DataFrame:
    """Rows (see SCHEMA) of the project files among (path, text and, where there is one, repo)."""
    repo = F.col("repo") if "repo" in files.columns else F.lit("")
    return files.filter(F.col("path").rlike(WANTED)).select(repo.alias("repo"), "path", "text").mapInArrow(_run, SCHEMA)
