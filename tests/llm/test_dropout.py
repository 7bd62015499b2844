"""Dropout varies by document and occurrence, with the chances of the method, whatever a worker has kept."""

import random

import numpy as np
import public_tokenizers

from dataspoor.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_occurrences_and_copies_are_cut_by_themselves(spark):
    text = "internationalization " * 200
    got = pieces.encode_pieces(spark.createDataFrame([(k, text) for k in range(40)], "doc_id long, text string"), MODEL).collect()
    assert len({tuple(r.ids) for r in got}) == 40
    c, word = pieces.PieceCoder(MODEL), "internationalization"
    assert len({c.encode(word, c.key(k)) for k in range(2000)}) > 50
    one = c.encode(text, c.key(0))
    assert len(one) % 200 or one[: len(one) // 200] * 200 != one


def test_kept_words_change_nothing():
    texts = [f"hello internationalization {'x' * 300} {k} word.word\n日本 ▁" for k in range(200)]
    warm = pieces.PieceCoder(MODEL, 0.3, 7)
    for k, t in enumerate(texts):
        warm.encode(t, warm.key(f"other {k}"))
    for k, t in enumerate(texts):
        cold = pieces.PieceCoder.__new__(pieces.PieceCoder)
        cold.__dict__.update(warm.__dict__, known={}, old={}, held=0)
        ids = warm.encode(t, warm.key(k))
        assert cold.encode(t, cold.key(k)) == ids and warm.decode(memoryview(ids).cast("I")) == t


def test_gaps_have_the_chance_of_dropout():
    gaps = pieces.PieceCoder(MODEL, 0.1).gaps(5, 0, 200_000)
    assert abs(gaps.count(0) / 200_000 - 0.1) < 0.004 and abs(sum(gaps) / 200_000 - 9) < 0.15
    assert set(pieces.PieceCoder(MODEL, 1.0).gaps(5, 0, 100)) == {0}


def test_segments_equal_a_plain_twin():
    """Every step looks over all neighbours anew, without an agenda."""

    def twin(c, unit, gaps):
        parts, gone, gaps, seen = [(k, k + 1) for k in range(len(unit))], set(), iter(gaps), 0
        gap = next(gaps)
        while True:
            open_ = [(c.rank[unit[a:d]], a, b, d) for (a, b), (_, d) in zip(parts, parts[1:]) if unit[a:d] in c.rank and (a, b, d) not in gone]
            if not open_:
                return [unit[a:b] for a, b in parts]
            _, a, b, d = min(open_)
            if seen == gap:
                gone.add((a, b, d))
                gap, seen = next(gaps), 0
            else:
                seen += 1
                k = parts.index((a, b))
                parts[k : k + 2] = [(a, d)]

    c, r = pieces.PieceCoder(MODEL, 0.3), random.Random(2)
    words = ["internationalization", "antidisestablishmentarianism", "aaaaaaaaaaaa", "the", "ﬁx日本語", "mississippi", "x" * 40] + ["".join(r.choice("etaoinshr") for _ in range(r.randrange(1, 30))) for _ in range(80)]
    for w in words:
        for _ in range(12):
            gaps = [r.choice([0, 0, 1, 2, 3, 8]) for _ in range(200)]
            assert c.segment("▁" + w, iter(gaps))[0] == twin(c, "▁" + w, gaps)


def test_tables_stay_small_whatever_the_words(monkeypatch):
    monkeypatch.setattr(pieces, "ROOM", 50)
    c = pieces.PieceCoder(MODEL, 0.3)
    text = " ".join(["y" * 5000, *(f"word{k}" for k in range(3000))])
    assert c.decode(memoryview(c.encode(text, 3)).cast("I")) == text
    assert c.held <= 26 and len(c.known) + len(c.old) <= 52 and not any(len(k) > pieces.KEPT_CHARS for k in c.known)


def test_words_cut_at_once_equal_words_cut_one_by_one():
    r = random.Random(3)
    words = ["▁" + w for w in ["", "the", "internationalization", "mississippi", "a" * 40, "ab" * 20, "日本語ﬁx", "z\U0001f9ffß"]]
    words += ["▁" + "".join(r.choice("etaoinshräß.") for _ in range(r.randrange(1, 40))) for _ in range(600)]
    n, odd = len(words), 0
    for dropout in (0.0, 0.1, 0.5, 1.0):
        c = pieces.PieceCoder(MODEL, dropout, 5)
        keys, sizes = np.array([r.getrandbits(64) for _ in words], np.uint64), np.arange(n) + n
        for k, got in enumerate(c.cut(words, keys, np.arange(n), sizes)):
            odd += got is None
            assert got is None or got == c.alone(words[k], iter(c.gaps(int(keys[k]), k, 1000, n + k)))
    assert odd == 4


def test_words_of_a_text_are_not_cut_one_by_one(monkeypatch):
    c, alone = pieces.PieceCoder(MODEL, 0.1), []
    segment = c.segment
    monkeypatch.setattr(c, "segment", lambda unit, gaps: alone.append(unit) or segment(unit, gaps))
    text = " ".join(f"{a}{b}" for a in ("inter", "national", "merge", "cut") for b in ("ization", "ally", "able", "s")) * 50
    assert c.decode(memoryview(c.encode(text, 3)).cast("I")) == text and not alone


def test_a_word_is_cut_by_its_place_whatever_stands_before():
    """The mark ▁ before the last word has three ids of its own, so they tell where that word begins."""
    c, seen = pieces.PieceCoder(MODEL, 0.5), set()
    for k in range(100):
        ends = {c.encode(f"{x}▁internationalization", k).rpartition(c.mark)[2] for x in ("a", "antidisestablishmentarianism")}
        assert len(ends) == 1
        seen |= ends
    assert len(seen) > 50


def test_texts_together_equal_texts_alone(monkeypatch):
    monkeypatch.setattr(pieces, "TOGETHER", 30)
    monkeypatch.setattr(pieces, "BLOCK", 7)
    texts = ["", "\n", "\n\n\n" * 20, "a\n", "▁", " ▁ x", "a  b", "x" * 100, "\U0001f9ff y", *(f"hello internationalization {k} word.word\n日本" * (k % 9) for k in range(60))]
    together, alone = pieces.PieceCoder(MODEL, 0.3), pieces.PieceCoder(MODEL, 0.3)
    assert together.encode_all(texts, list(range(len(texts)))) == [alone.encode(t, k) for k, t in enumerate(texts)]
