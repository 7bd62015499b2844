"""Rows of parsed files as Arrow batches: many files' rows in one batch, made column by column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Rows after which a batch is handed on; a file's rows stay together.
ROWS = 5000


def _column(values: list, of):
    """An Arrow array of Python values; lists of structs are laid out by their fields."""
    import pyarrow as pa

    if not (pa.types.is_list(of) and pa.types.is_struct(of.value_type)):
        return pa.array(values, of)
    ends, flat = [], []
    for v in values:
        ends.append(None if v is None else len(flat))
        if v:
            flat += v
    ends.append(len(flat))
    parts = [_column([x.get(f.name) for x in flat], f.type) for f in of.value_type]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(of.value_type)))


def _batch(rows: list[dict], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([_column([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def parsed(batches: Iterator, schema, read: Callable[[str, str, str], list[dict]]) -> Iterator:
    """Batches of what `read` makes of each file (repo, path, text); a field that a row leaves out is null."""
    rows: list[dict] = []
    for b in batches:
        for repo, path, text in zip(*[b.column(c).to_pylist() for c in ("repo", "path", "text")], strict=True):
            rows += read(repo, path, text or "")
            if len(rows) >= ROWS:
                yield _batch(rows, schema)
                rows = []
    if rows:
        yield _batch(rows, schema)
