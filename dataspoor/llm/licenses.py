"""License scans: short notices, found with a bounded number of edits.

A notice that occurs with at most k edits leaves at least one of k+1 parts of it
unchanged (pigeonhole), so an automaton over all parts finds every place worth a
look; there the regex library's bounded-error matching decides and gives the
span. Phrases of PHRASES are found exactly, by consecutive words.

Edits may not fall on what tells notices apart: the words between brackets in
NOTICES have to stand in the span in their order, short ones unchanged, those of
LONG_WORD letters or more with one edit for so many letters at most and no other
telling word in their place. Where spans of two notices overlap, the one with
fewer edits for its length stands; of two alike both do.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coding import small_batches

PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
NOTICES = (
    ("mit", "released under the [mit] license"),
    ("mit", "licensed under the [mit] license"),
    ("mit", "permission is hereby granted [free of charge] to any person obtaining a copy of this software"),
    ("apache", "licensed under the [apache] license version [2] 0"),
    ("apache", "spdx license identifier [apache 2] 0"),
    ("gpl", "licensed under the gnu [general] public license version"),
    ("gpl", "under the terms of the gnu [general] public license"),
    ("lgpl", "gnu [lesser] general public license"),
    ("agpl", "gnu [affero] general public license"),
    ("cc-by", "licensed under [cc by 4 0]"),
    ("cc-by-sa", "licensed under [cc by sa 4 0]"),
    ("cc-by-nc", "licensed under [cc by nc 4 0]"),
    ("cc-by-nd", "licensed under [cc by nd 4 0]"),
    ("cc-by-nc-sa", "licensed under [cc by nc sa 4 0]"),
    ("cc-by-nc-nd", "licensed under [cc by nc nd 4 0]"),
    ("cc-by", "creative commons [attribution 4 0] international license"),
    ("cc-by-sa", "creative commons [attribution sharealike 4 0] international license"),
    ("cc-by-nc", "creative commons [attribution noncommercial 4 0] international license"),
    ("cc-by-nd", "creative commons [attribution noderivatives 4 0] international license"),
    ("cc0", "creative commons [zero] v1 0 universal"),
    ("bsd", "[redistribution] and use in source and binary forms with or without modification are permitted"),
    *((label, f"{how} under the [{label}] license") for label in ("bsd", "bsl", "isc", "mpl") for how in ("released", "licensed")),
    ("mpl", "[mozilla] public license version 2 0"),
    ("epl", "[eclipse] public license version 2 0"),
    ("isc", "permission to use copy [modify] and or distribute this software for any purpose"),
    ("unlicense", "this is free and [unencumbered] software released into the public domain"),
    ("reserved", "all rights [reserved]"),
)
#: A telling word of so many letters may have an edit for as many.
LONG_WORD = 6
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 12
#: Bytes to words: A-Z lowered, ASCII other than letters and digits to spaces, all others kept.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_GAPS = re.compile(" ").finditer
_SCANNERS: dict = {}


def _near(a: str, b: str, most: int) -> bool:
    """Whether at most `most` edits make b of a."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.phrases = [(label, f" {phrase} ") for label, phrase in phrases]
        self.notices, seeds = [], {}
        for n, (label, marked) in enumerate(notices):
            notice, telling = marked.replace("[", "").replace("]", ""), " ".join(re.findall(r"\[(.*?)\]", marked)).split()
            k = len(notice) // chars_per_edit
            self.notices.append((label, len(notice), k, regex.compile(f"(?:{regex.escape(notice)}){{e<={k}}}", regex.BESTMATCH), telling))
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[lo:hi], []).append((n, lo))
        self.told = {w for *_, telling in self.notices for w in telling}
        self.automaton = ahocorasick.Automaton()
        for seed, of in seeds.items():
            self.automaton.add_word(seed, (len(seed), of))
        self.automaton.make_automaton()

    def _tells(self, telling: list[str], words: list[str]) -> bool:
        """Whether the telling words stand among these words in their order."""
        at = 0
        for t in telling:
            while at < len(words) and not (words[at] == t or len(t) >= LONG_WORD and words[at] not in self.told and _near(words[at], t, len(t) // LONG_WORD)):
                at += 1
            at += 1
        return at <= len(words)

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, float]]]:
        """(words, base places, spans): a place is (label, word), a span (label, first word, last word, edits, share kept)."""
        words = (text or "").encode().translate(_TO_WORDS).split()
        line = f" {b' '.join(words).decode()} "
        base = []
        gaps: list[int] = []

        def word_at(at: int) -> int:
            """Number of the word that starts at this character or after it."""
            if not gaps:
                gaps.extend(m.start() for m in _GAPS(line))
            return bisect_left(gaps, at)

        if " license " in line:
            for label, phrase in self.phrases:
                at = line.find(phrase)
                while at >= 0:
                    base.append((label, word_at(at)))
                    at = line.find(phrase, at + 1)
        starts: dict[int, set[int]] = {}
        for last, (size, of) in self.automaton.iter(line):
            for n, lo in of:
                starts.setdefault(n, set()).add(last + 1 - size - lo)
        spans = []
        for n, found in starts.items():
            label, size, k, pattern, telling = self.notices[n]
            done = -1
            for at in sorted(found):
                if at + size + k <= done or at < done:
                    continue
                if m := pattern.search(line, max(0, at - k), min(len(line), at + size + k)):
                    s, e = m.span()
                    # Words that the span cuts count whole.
                    s, e = line.rfind(" ", 0, s + 1) + 1 if line[s] != " " else s + 1, line.find(" ", max(s, e - 1))
                    within = line[s:e].split()
                    done = m.end()
                    if within and self._tells(telling, within):
                        first, edits = word_at(s - 1), sum(m.fuzzy_counts)
                        spans.append((label, first, first + len(within) - 1, edits, 1 - edits / size))
        spans = sorted(set(spans), key=lambda x: (x[1], x[2], x[0], x[3]))
        return len(words), base, [x for x in spans if not self._beaten(x, spans)]

    @staticmethod
    def _beaten(x: tuple, spans: list[tuple]) -> bool:
        """Whether another label's span that overlaps x keeps a larger share."""
        return x[3] > 0 and any(y[0] != x[0] and y[1] <= x[2] and x[1] <= y[2] and y[4] > x[4] for y in spans)


def _scan(batches):
    import pyarrow as pa

    scanner = _SCANNERS.setdefault(0, None) or _SCANNERS.update({0: Scanner()}) or _SCANNERS[0]
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("kept", pa.float64())]))
    names = ("label", "first_word", "last_word", "edits", "kept")
    for b in batches:
        got = [scanner.scan(t) for t in b.column("text").to_pylist()]
        at = [[p for _, p in base] for _, base, _ in got]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                pa.array([n for n, _, _ in got], pa.int64()),
                pa.array([len(p) for p in at], pa.int64()),
                pa.array([min(p, default=None) for p in at], pa.int64()),
                pa.array([max(p, default=None) for p in at], pa.int64()),
                pa.array([",".join(sorted({x for x, _ in base})) for _, base, _ in got], pa.string()),
                pa.array([",".join(sorted({x for x, _ in base} | {s[0] for s in spans})) for _, base, spans in got], pa.string()),
                pa.array([max([float(bool(base)), *(s[4] for s in spans)]) for _, base, spans in got], pa.float64()),
                pa.array([[dict(zip(names, s)) for s in spans] for _, _, spans in got], kind),
            ],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every text.

    A null or empty text has no words, no place, empty labels and score 0. score:
    1 for an exact phrase, else the best span's share of characters not edited.
    Repeated rows each get their row; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int,kept:double>>")


def op10_fuzzy_notices(spark, sf_dir: str) -> DataFrame:
    """Licenses named or nearly named in every document."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
