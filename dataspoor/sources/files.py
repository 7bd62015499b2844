"""Source trees as tables: listing, revisions, languages, limits and configuration texts."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages that are known, and those that carry logic but aren't read, by extension.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "cs": "csharp", "razor": "csharp"}
UNSUPPORTED = {
    "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "rb": "ruby", "php": "php", "cshtml": "razor-pages", "fs": "fsharp", "rs": "rust", "swift": "swift", "m": "objective-c",
    "ex": "elixir", "exs": "elixir", "erl": "erlang", "clj": "clojure", "dart": "dart", "vue": "vue", "svelte": "svelte", "astro": "astro",
}
#: What is left out of a scan unless a project says otherwise: dependencies and generated code, tests, seeds and mocks.
DEFAULT_EXCLUDES = (
    "**/node_modules/**", "**/vendor/**", "**/third_party/**", "**/bower_components/**", "**/dist/**", "**/build/**", "**/out/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/coverage/**", "**/__pycache__/**",
    "**/.venv/**", "**/venv/**", "**/site-packages/**", "**/.tox/**", "**/migrations/**", "**/*.min.js", "**/*.bundle.js", "**/*.d.ts", "**/*.generated.*", "**/{bin,obj}/**/*.{cs,razor}", "**/Migrations/**/*.cs",
    "**/*.Designer.cs", "**/*.g.cs", "**/*.g.i.cs",
    "**/test/**", "**/tests/**", "**/__tests__/**", "**/spec/**", "**/*.test.*", "**/*.spec.*", "**/test_*.py", "**/*_test.py", "**/conftest.py", "**/fixtures/**", "**/__fixtures__/**", "**/__mocks__/**", "**/testdata/**",
    "**/e2e/**", "**/cypress/**", "**/playwright/**", "**/*.{Tests,UnitTests,FunctionalTests,IntegrationTests}/**", "**/*.stories.*", "**/storybook-static/**",
    "**/seed/**", "**/seeds/**", "**/seeders/**", "**/*.seed.*", "**/mocks/**", "**/__generated__/**",
)
MAX_BYTES = 2 << 20


def _by_extension(path: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(known, F.regexp_extract(path, r"\.([^./]*)$", 1))


def language_of(path: Column) -> Column:
    """The language a file is read as, else null; extensions are case-sensitive."""
    return _by_extension(path, LANGUAGES)


def unsupported_of(path: Column) -> Column:
    """The known language that isn't read, else null."""
    return _by_extension(path, UNSUPPORTED)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length) of all files below a folder that Spark reads, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.expr("decode(encode(path, 'UTF-8'), 'UTF-8')"), "^.*?" + _quoted(base.split("://")[-1]) + "/", "")
    return files.select(relative.alias("path"), "content", "length")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def with_text(files: DataFrame) -> DataFrame:
    """files with `text`, its bytes read as UTF-8 with malformed ones replaced, without a byte order mark."""
    return files.withColumn("text", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))


def _git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True).stdout


def resolve_revision(root: str, name: str) -> str:
    """The commit that a name of a revision means."""
    if name.startswith("-"):
        raise ValueError(f"not a revision: {name!r}")
    return _git(root, "rev-parse", "--verify", "--end-of-options", f"{name}^{{commit}}").decode().strip()


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length, revision, dirty) of the tracked files of a work tree.

    The driver lists names; executors' reader loads the contents.
    """
    names = [n for n in _git(root, "ls-files", "-z").decode().split("\0") if n]
    head = resolve_revision(root, "HEAD")
    dirty = bool(_git(root, "status", "--porcelain", "--untracked-files=no").strip())
    listed = spark.createDataFrame([(n,) for n in names], "path string")
    return walk(spark, root).join(listed, "path", "left_semi").withColumns({"revision": F.lit(head), "dirty": F.lit(dirty)})


def revision(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, content, length, revision) of a commit, read from the object store without a checkout."""
    commit = resolve_revision(root, name)
    entries = [e.split("\t", 1) for e in _git(root, "ls-tree", "-r", "-z", commit).decode().split("\0") if e]
    blobs = [(meta.split()[2], path) for meta, path in entries if meta.split()[1] == "blob"]
    asked = "".join(f"{sha}\n" for sha, _ in blobs).encode()
    data = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=asked, check=True, capture_output=True).stdout
    rows, at = [], 0
    for _, path in blobs:
        end = data.index(b"\n", at)
        size = int(data[at:end].split()[2])
        rows.append((path, bytearray(data[end + 1 : end + 1 + size]), size, commit))
        at = end + 2 + size
    return spark.createDataFrame(rows, "path string, content binary, length long, revision string")


def size_guard(files: DataFrame, limit: int = MAX_BYTES, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(files to read, gaps of those over the limit in bytes)."""
    large = F.octet_length(text_col) > limit
    return files.filter(~large), files.filter(large).withColumn("kind", F.lit("parse_error"))


def strip_jsonc(text: Column) -> Column:
    """JSON with comments and trailing commas taken out; what stands in strings stays."""
    string = r'("(?:[^"\\]|\\.)*")'
    bare = F.regexp_replace(text, string + r"|//[^\n]*|/\*(?s:.*?)\*/", "$1")
    return F.regexp_replace(bare, string + r"|,(\s*[}\]])", "$1$2")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or the predicate of an attestation that holds one."""
    raw = spark.read.text(path, wholetext=True)
    whole, inner = F.from_json("value", schema), F.from_json("value", f"predicate {schema if schema.startswith('struct') else f'struct<{schema}>'}")
    return raw.select(F.coalesce(inner["predicate"], whole).alias("doc")).select("doc.*")
