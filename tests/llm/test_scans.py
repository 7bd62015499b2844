"""License spans, language accuracy and neighbours' recall."""

import re

import numpy as np
from pyspark.sql import functions as F

from dataspoor.llm import language, licenses, neighbours

SF = "/root/testdata/sf0.01"


def test_base_places_and_fuzzy_spans(spark):
    texts = [None, "", "MIT License, mit  license; MITlicense", "The GNU General Public License", "an apache-license mit license mit", "Permision is hereby grantd, free of charge, to any person obtaining a copy of this softwear", "Licensed under the Apache License, Version 2.0.", "nothing to see here at all", "Licensed undr the GNU Generel Public Licence, version 3"]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((k, lab) for lab, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert 0 <= r.score <= 1
    assert got[5].labels == "mit" and got[5].spans[0].edits > 0
    assert got[8].labels == "gpl" and got[8].base_labels == ""
    assert got[7].labels == ""


def plain(marked):
    return marked.replace("[", "").replace("]", "")


def test_no_notice_is_taken_for_another():
    scanner = licenses.Scanner()
    for label, marked in licenses.NOTICES:
        text, telling = plain(marked), " ".join(re.findall(r"\[(.*?)\]", marked)).split()
        assert {s[0] for s in scanner.scan(f"so it is {text} here")[2]} == {label}, text
        for other, theirs in licenses.NOTICES:
            words = " ".join(re.findall(r"\[(.*?)\]", theirs)).split()
            if other != label and words != telling:
                swapped = re.sub(r"\[.*?\]", " ".join(words), marked, count=1)
                assert label not in {s[0] for s in scanner.scan(f"so it is {plain(swapped)} here")[2]}, (label, swapped)
    for text, want in {"licensed under CC BY-SA 4.0": "cc-by-sa", "CC BY-ND 4.0, licensed under CC BY-ND 4.0": "cc-by-nd", "released under the MPL license": "mpl", "licensed under the BSL license": "bsl", "licensed under the QPL license": None, "released under the MIT Lisense": "mit", "licensed under the Apach License, version 2.0": "apache", "All rights reserved": "reserved"}.items():
        assert {s[0] for s in scanner.scan(text)[2]} == ({want} if want else set()), text


def test_fuzzy_labels_equal_an_exhaustive_search():
    """Sellers' table over the whole text instead of seeds and the regex library."""

    def least(notice, text):
        row = list(range(len(notice) + 1))
        best = row[-1]
        for c in text:
            last, row[0] = row[0], 0
            for j, x in enumerate(notice, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != c))
            best = min(best, row[-1])
        return best

    r, scanner, seen = np.random.default_rng(7), licenses.Scanner(), [0, 0]
    for _ in range(250):
        label, marked = licenses.NOTICES[r.integers(len(licenses.NOTICES))]
        parts = re.split(r"(\[.*?\])", marked)
        for _ in range(r.integers(0, len(marked) // 9 + 2)):
            k = 2 * r.integers(0, len(parts) // 2 + 1)
            if len(parts[k]) > 2:
                at, c = r.integers(1, len(parts[k]) - 1), "qxj"[r.integers(3)]
                parts[k] = parts[k][:at] + [c, "", c + parts[k][at]][r.integers(3)] + parts[k][at + 1 :]
        text = f"we say that {plain(''.join(parts))} and that is all"
        within = any(least(plain(m), f" {text} ") <= len(plain(m)) // licenses.CHARS_PER_EDIT for x, m in licenses.NOTICES if x == label)
        own = least(plain(marked), f" {text} ") <= len(plain(marked)) // licenses.CHARS_PER_EDIT
        got = label in {s[0] for s in scanner.scan(text)[2]}
        assert got <= within and own <= got, (label, text)
        seen[got] += 1
    assert min(seen) > 20


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op2_zstd_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert right >= 0.97 * len(got)
    assert max(r.score for r in got) <= 1 and min(r.score for r in got) >= 0


def test_every_sampled_row_is_in_the_dictionary(spark):
    body = " ".join(["filler"] * 700)
    rows = [(k, f"mark{k:04d}x {body}" if k % 3 == 0 else f"mark{k:04d}x short text", "en") for k in range(300)] + [(900, None, "en"), (901, "x", None)]
    got = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=400, chars=2048, size=96 << 10)
    assert set(got) == {"en"} and len(got["en"]) <= 96 << 10
    assert all(f"mark{k:04d}x".encode() in got["en"] for k in range(300))
    few = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=25)["en"]
    assert sum(f"mark{k:04d}x".encode() in few for k in range(300)) == 25


def test_predictions_equal_a_plain_twin():
    import zstandard

    made = {"aa": b"the cat sat on the mat and the dog lay on the rug " * 9, "bb": b"el gato estaba en la alfombra y el perro en el suelo " * 9}
    sizer = language.Sizer(made)
    for text in ["The cat and the dog", "el perro y el gato", "½ ² Ⅷ ① 12", "", None, "日本", "x", "THE MAT " * 5000]:
        got = sizer.predict(text)
        if not text or not any(c.isalpha() for c in text):
            assert got == ("und", 0.0)
            continue
        data, sizes = text.lower().encode(), {}
        for lang, d in made.items():
            z = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes[lang] = sum(len(z.compress(data[k : k + language.BLOCK])) for k in range(0, len(data), language.BLOCK))
        first, second = sorted(sizes.values())
        assert got == (min(sizes, key=sizes.get), max(0.0, 1 - first / second))


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    v, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    found: dict = {}
    for r in neighbours.op4_permutation_index(spark, SF).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for n in np.flatnonzero(ids % 20 == 0):
        s = v @ v[n]
        s[n] = -np.inf
        best = sorted(range(len(ids)), key=lambda k: (-s[k], ids[k]))[:20]
        mine = sorted(found[ids[n]])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - v[n] @ v[list(ids).index(m[1])]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & {int(ids[k]) for k in best})
        total += 20
    assert hits >= 0.9 * total


def test_neighbours_recall_on_many_segments_and_norms(spark):
    r = np.random.default_rng(1)
    n, centres, spans = 50_000, r.normal(size=(300, 32)), r.normal(size=(300, 6, 32))
    at = r.integers(0, 300, n)
    v = (centres[at] + 0.25 * np.einsum("nk,nkd->nd", r.normal(size=(n, 6)), spans[at])) * np.exp(0.5 * r.normal(size=(n, 1)))
    v[n - 40 :] = v[:40]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    found: dict = {}
    for h in neighbours.search(rows, F.col("vec_id") % 250 == 0).collect():
        found.setdefault(h.query_id, {})[h["rank"]] = (h.vec_id, h.score)
    hits = 0
    for q in range(0, n, 250):
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(n), -s))[:20]
        mine = [found[q][k] for k in range(1, 21)]
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0])) and all(abs(x - s[k]) < 1e-9 for k, x in mine)
        hits += len({k for k, _ in mine} & set(best.tolist()))
    assert hits >= 0.9 * 20 * len(found) and len(found) == 200


def test_only_the_training_fold_is_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(~language.held_out(F.col("doc_id")))
    assert set(language.learn(docs)) == {"de", "en", "es", "fr"}
