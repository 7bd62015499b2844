"""Encoders against the libraries, exact round trips, and what the files hold."""

import random
import zlib
from array import array
from collections import Counter
from itertools import combinations

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dataspoor.llm import coding, packing, pieces, token_store
from dataspoor.llm.coding import coder
from dataspoor.llm.common import new_path


def texts():
    r = random.Random(5)
    odd = ["", " ", "  two  spaces ", "tab\tand\r\nline", "it's we'll I'D", "naïve café größe ²³ ½", "日本語 текст 😀 a😀b", "<|endoftext|> x", "a <|endoftext|> b", "<|STARTOFTEXT|> c<|startoftext|>", "end. of, it,\nnow.\nlast.", "x_. y, *, z., w.", "½, é. ÿ, ·. ²,", "\x00\x01\x02", "a b c", "word." * 50, "x" * 3000, "\n\nlead", "trail \n", "ǅ İ ß K", "1234567 12,3.4", "\x01 mark", "A\x85B"]
    some = [" ".join(r.choice(["the", "of", "it's", "x1", "é", "Foo-bar", "“q”", "\n", "y,"]) for _ in range(r.randrange(40))) for _ in range(60)]
    return odd + some


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_coders_equal_the_library():
    for name, split in (("byte_bpe_50k.json", "lead"), ("word_bpe_49k.json", "blank")):
        own, theirs = coder(public_tokenizers.path(name), split), library(name)
        for t in texts():
            assert list(memoryview(own.encode([t])[0]).cast("I")) == theirs(t), (name, t)


def test_tables_stay_within_their_bytes():
    from dataspoor.llm.coding import ENTRY, Kept

    made, kept = [], Kept(lambda w: made.append(w) or w.encode() * 4, room=20_000)
    for k in range(3000):
        assert kept[f"word{k}"] == f"word{k}".encode() * 4 and kept["often"] == b"often" * 4
        assert sum(len(a) + len(b) + ENTRY for d in (kept, kept.old) for a, b in d.items()) <= 21_000
    assert kept["x" * 5000] and "x" * 5000 not in kept
    assert made.count("often") == 1


def test_words_are_made_once_and_stay_within_their_bytes(monkeypatch):
    made, words = [], coding.Words(room=20_000)
    for k in range(300):
        units = [*(f"word{k * 10 + j}" for j in range(10)), "often", "x" * 5000, ""]
        got = words.ids(pa.array(units, pa.large_string()), lambda w: made.append(w) or w.encode() * 4)
        assert got.to_pylist() == [w.encode() * 4 for w in units] and words.words.nbytes + words.coded.nbytes <= 20_000
    assert made.count("often") == 1 and made.count("x" * 5000) == 300
    monkeypatch.setattr(coding, "HELD", 500)
    for name, split in (("byte_bpe_50k.json", "lead"), ("word_bpe_49k.json", "blank")):
        for room in (1, 100, 1 << 20):
            monkeypatch.setattr(coding, "SLICE", room)
            own, theirs = coding.Coder(public_tokenizers.path(name), split), library(name)
            assert [list(memoryview(x).cast("I")) for x in own.encode(texts())] == [theirs(t) for t in texts()]
            batches = [pa.record_batch({"text": pa.array(x, pa.string())}) for x in (texts()[:40], [None, "a b"], [], texts()[40:])]
            both = list(own.encode_batches(batches))
            assert [b.num_rows for b, _ in both] == [len(x) for _, x in both] and sum((x for _, x in both), []) == own.encode([t or "" for b in batches for t in b["text"].to_pylist()])


def test_distinct_words_of_a_slice_are_looked_up_once(monkeypatch):
    own, asked = coding.Coder(public_tokenizers.path("byte_bpe_50k.json"), "lead"), []
    make = own.make
    monkeypatch.setattr(coding, "LONGEST", 0)  # nothing is kept from slice to slice
    own.make = lambda w: asked.append(w) or make(w)
    own.encode(["of course they say"] * 500)
    assert len(asked) == len(set(asked))


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def test_token_files(spark):
    rows = [(k * 3 % 101, t) for k, t in enumerate(texts())] + [(500, None)]
    path = new_path(spark, "tokens")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    files, encode = spark.read.parquet(path), library("byte_bpe_50k.json")
    want, start = {}, 0
    for d, t in sorted(rows):
        ids = [*encode(t or ""), 2]
        want[d] = (start, len(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens) for r in token_store.read_places(files).collect()} == want
    part = {r.doc_id: r.ids for r in token_store.read_range(files, 3, 9).collect()}
    assert part == {d: [*encode(t or ""), 2] for d, t in rows if 3 <= d <= 9}
    meta = pq.ParquetFile(next(p for p in sorted(__import__("pathlib").Path(path).glob("*.parquet")) if pq.ParquetFile(p).metadata.num_rows)).metadata
    column = meta.row_group(0).column(0)
    assert column.has_offset_index or column.has_column_index


def test_pieces_round_trip_and_dropout(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain, dropped = pieces.PieceCoder(model, 0.0), pieces.PieceCoder(model, 0.3, seed=4)
    changed = 0
    for t in texts():
        a, b = plain.encode(t), dropped.encode(t, 1)
        assert plain.decode(memoryview(a).cast("I")) == t and dropped.decode(memoryview(b).cast("I")) == t
        assert b == pieces.PieceCoder(model, 0.3, seed=4).encode(t, 1)
        changed += a != b
    assert changed > 20
    for t in ["the quick brown fox", "hello world again"]:
        assert list(memoryview(plain.encode(t)).cast("I")) == sp.encode(t)
    rows = list(enumerate(texts())) + [(900, None)]
    coded = pieces.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string"), model)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(coded, model).collect()}
    assert back == {d: t or "" for d, t in rows}


def test_packing_places_every_piece_once(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(200, "word " * 9000), (201, None)] + [(300 + k, "same text") for k in range(200)]
    encode = library("word_bpe_49k.json")
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect()
    want = {}
    for d, t in rows:
        ids = [*encode(t or ""), 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            want[d, p] = (s, len(ids[s : s + 2048]), crc(ids[s : s + 2048]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x[1] for x in want.values())
    assert len(by) <= -(-total // 2048) + 2


def test_bin_completion_is_optimal_on_small_cases():
    def exact(items, cap):
        best = [len(items)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for b in sorted(set(bins)):
                if b >= items[k]:
                    rest = list(bins)
                    rest.remove(b)
                    go(k + 1, [*rest, b - items[k]])
            go(k + 1, [*bins, cap - items[k]])

        items.sort(reverse=True)
        go(0, [])
        return best[0]

    r = random.Random(9)
    for cap, most, n in ((12, 13, 60), (30, 24, 60), (100, 70, 25)):
        for _ in range(n):
            items = [r.randrange(1, most) for _ in range(r.randrange(1, 13))]
            hist = Counter(items)
            plan = packing.bin_completion(hist, cap, None)
            assert sum(n for _, n in plan) == exact(items, cap) >= packing.lower_bound(hist, cap)
            assert used(plan, cap) == hist


def used(plan, capacity):
    out: Counter = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= capacity
        for x in pattern:
            out[x] += n
    return out


def test_fillings_are_all_undominated_ones():
    def fits(small, big):
        return not small or any(b >= small[0] and fits(small[1:], [*big[:k], b - small[0], *big[k + 1 :]]) for k, b in enumerate(big))

    r = random.Random(3)
    for _ in range(150):
        hist, gap = Counter(r.randrange(1, 12) for _ in range(r.randrange(1, 8))), r.randrange(1, 20)
        every = {f for n in range(sum(hist.values()) + 1) for f in combinations(sorted(hist.elements(), reverse=True), n) if sum(f) <= gap}
        best = {f for f in every if not any(f != g and fits(list(f), list(g)) for g in every)}
        got = list(packing.fillings(hist, gap))
        assert sorted(got) == sorted(best) and [gap - sum(f) for f in got] == sorted(gap - sum(f) for f in got)


def test_perfect_packings_are_found():
    r = random.Random(4)
    for n in [30] * 8 + [40] * 8 + [200]:
        hist: Counter = Counter()
        for _ in range(n):
            at = sorted(r.sample(range(1, 2048), r.randrange(2, 8)))
            hist.update(b - a for a, b in zip([0, *at], [*at, 2048]))
        plan = packing.bin_completion(hist)
        assert sum(k for _, k in plan) == n == packing.lower_bound(hist, 2048)
        assert used(plan, 2048) == hist


def test_one_length_that_fills_most_rows(spark):
    pieces = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") < 9000, 2048).when(F.col("id") < 19_000, 700).otherwise(F.col("id") % 650 + 1).cast("long").alias("length"))
    got = packing.pack(pieces.withColumn("part", F.lit(3)), steps=50)
    assert got.columns == ["doc_id", "piece", "length", "part", "sequence_id", "offset"] and got.count() == 20_000
    by = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("p"))
    for n, p in by.select("n", "p").collect():
        assert n <= 2048 and [x["offset"] for x in p] == [sum(y["length"] for y in p[:k]) for k in range(len(p))]
