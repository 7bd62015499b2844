"""Line dedup against a comparison of all pairs of places."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from dataspoor.llm.line_dedup import remove_repeats, repeated_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, least):
    """doc -> (text, lines, removed): every place against every earlier one."""
    units = {}
    for d, text in docs:
        rows, head = [], []
        for line in text.split("\n"):
            if WORD.search(line):
                rows.append([line])
            elif rows:
                rows[-1].append(line)
            else:
                head.append(line)
        units[d] = (head, rows)
    seqs = [(d, [r[0].strip(" \t\n\x0b\f\r") for r in units[d][1]]) for d in sorted(units)]
    out = {}
    for n, (d, s) in enumerate(seqs):
        gone = set()
        for p in range(len(s)):
            best = 0
            for m in range(n + 1):
                t = seqs[m][1]
                for q in range(len(t) if m < n else p):
                    k = 0
                    while p + k < len(s) and q + k < len(t) and s[p + k] == t[q + k]:
                        k += 1
                    best = max(best, k)
            if best and sum(len(WORD.findall(x)) for x in s[p : p + best]) >= least:
                gone |= set(range(p, p + best))
        head, rows = units[d]
        kept = (["\n".join(head)] if head else []) + ["\n".join(r) for k, r in enumerate(rows) if k not in gone]
        out[d] = ("\n".join(kept), len(s), len(gone))
    return out


def held(spark, texts, least):
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
    assert got == brute(rows, least)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b b", "c c c", "", " ", "d d d d d d"]), max_size=14).map("\n".join), min_size=1, max_size=8), st.integers(2, 7))
def test_random_texts(spark, texts, least):
    held(spark, texts, least)


def test_overlaps_and_edges(spark):
    held(spark, ["a\na\na\na\na\na", "a\na\nx", "\n\na\n\na\nq\n", "a a a", "q\nw\ne\nr", "w\ne"], 2)


def test_long_run_needs_all_levels(spark):
    lines = [f"w{k}" for k in range(60)]
    held(spark, ["\n".join(lines), "\n".join(["x", *lines[:55], "y"]), "\n".join(lines[5:54])], 50)


def test_null_ids_come_first_and_equal_rows_stay_together(spark):
    text = "one two three"
    rows = [(None, text), (3, text), (3, text), (4, text), (5, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 3).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.n_removed) for r in got] == [(None, text, 0), (3, "", 1), (3, "", 1), (4, "", 1), (5, None, 0)]
    runs = repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted((r.id, r.s, r.e) for r in runs) == [(3, 0, 1), (4, 0, 1)]
