"""Files are parsed once, by tasks of all cores, and their rows leave the reader in few batches."""

import ast

import pyarrow as pa
import pytest

from dataspoor.plans import catalog
from dataspoor.sources import csharp, python, scripts

SF = "/root/testdata/sf0.001"
ONCE = ("a29_python_ir", "a30_declaration_scan", "a31_declaration_index", "a34_parse_errors", "a28_script_ir", "b21_doctor", "d2_name_heuristic", "d3_plain_method", "d4_data_method")
HELD = ("c26_record_use", "c27_records", "c35_skipped_parameters", "d12_find_handlers", "d13_typed_seeds", "d15_handler_seeds", "d18_copy_origin", "d19_defining_call", "d30_receiver_origins", "d31_context_datasets", "d32_class_datasets", "e22_hierarchy", "e23_specialise", "e28_call_targets")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ONCE)
def test_files_are_dealt_over_tasks(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert plan_of(df).count("MapInArrow") == 1 + (name == "a31_declaration_index") or "Union" in plan_of(df)
    assert "Repartition " in plan_of(df)


@pytest.mark.parametrize("name", HELD)
def test_files_are_parsed_before_what_reads_them_twice(spark, name):
    assert "MapInArrow" not in plan_of(catalog.queries()[name](spark, SF))


@pytest.mark.parametrize(("reader", "text"), [(python, "x = a.b\n"), (scripts, "const x = a.b;\n"), (csharp, "class A { }\n")])
def test_rows_of_many_files_share_a_batch(reader, text):
    files = pa.RecordBatch.from_pydict({"repo": ["r"] * 100, "path": [f"f{k}" for k in range(100)], "text": [text] * 100})
    got = list(reader._run(iter([files])))
    assert len(got) == 1 and len(set(got[0].column("path").to_pylist())) == 100


def test_citations_equal_the_library(monkeypatch):
    text = "x = f('é',\n   [ü for ü in  range(3)],\r\n  k={'a': 1})\nfor q in (1,\n 2): y = q.z\n" + "t = [" + ",\n".join(str(k) for k in range(90)) + "]\n"
    for node in ast.walk(ast.parse(text)):
        want = " ".join((ast.get_source_segment(text, node) or "").split())
        assert python.Lowering("", "p", text).cite(node) == (want if len(want) <= 80 else want[:79] + "…")


def test_kinds_that_are_asked_for():
    files = pa.RecordBatch.from_pydict({"repo": [""], "path": ["p"], "text": ["import a\nx = a.b\ny = x\n"]})
    whole = [r for b in python._run(iter([files])) for r in b.to_pylist()]
    some = [r for b in python._run(iter([files]), frozenset(["assign"])) for r in b.to_pylist()]
    assert some == [r for r in whole if r["kind"] == "assign"] and len(some) == 2 < len(whole)
