"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A BPE piece model merges on an agenda: the best-scored candidate first, the
leftmost among equals. With dropout each candidate that comes up is skipped
where a keyed hash says so; a skipped one is gone unless a neighbour changes.
The key is the seed, the document's id and the place of the word in it: one seed
always gives the same ids, and every occurrence of a word is cut by itself.
Pieces hold no space but at their start, so words are handled one by one.

Hashes are drawn as gaps, the numbers of candidates taken between two skipped
ones; those of a word are hashes of its place and of nothing that other words
took. The pieces of a word that skips none are kept. All other words of some
texts are cut at once, a candidate of each at a time, in arrays of numbers.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import chain, count, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coding import small_batches

#: Words kept per worker, some 300 bytes each, in two generations of half as many.
ROOM = 1_600_000
#: Longer words are neither kept nor cut in arrays.
KEPT_CHARS = 48
#: So many words are looked up together, of one text or several, and so many are cut at once.
TOGETHER, BLOCK = 16_384, 4096
#: A gap beyond any word's candidates.
_NEVER = 1 << 40
DROPOUT = 0.1
_MARK = "▁"
_RUNS = re.compile(f"\\n|{_MARK}*[^{_MARK}\\n]+|{_MARK}+")
_CODERS: dict = {}


class PieceCoder:
    def __init__(self, model: str, dropout: float = DROPOUT, seed: int = 0):
        import numpy as np
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(k) for k in range(n)]
        normal = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        self.ids_of = {names[k]: k for k in normal}.get
        self.rank = {names[k]: r for r, k in enumerate(sorted(normal, key=lambda k: (-sp.get_score(k), k)))}
        byte = {int(names[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        self.byte = [byte[b] for b in range(256)]
        self.mark = array("I", [self.byte[b] for b in _MARK.encode()]).tobytes()
        self.raw = [bytes([int(names[k][3:5], 16)]) if sp.is_byte(k) else b"" if sp.is_control(k) else names[k].replace(_MARK, " ").encode() for k in range(n)]
        self.dropout, self.seed = dropout, seed
        # A hash below the k-th number from the end takes more than k candidates before it skips one.
        longest = 0 if not 0 < dropout < 1 else int(-64 * math.log(2) / math.log1p(-dropout)) + 1
        self.steps = np.array([int((1 - dropout) ** k * (1 << 64)) for k in range(longest, 0, -1)], np.uint64)
        # By word: how many candidates come up if none is skipped, and its ids.
        self.known: dict = {}
        self.old: dict = {}
        self.held = 0
        self.tables()

    def tables(self) -> None:
        """Symbols are ranks, the last one stands for none: those of characters, the ids of symbols, and pairs of symbols with their merged one by hash."""
        import numpy as np

        rank, none = self.rank, len(self.rank)
        self.symbol = np.full(0x110000, none, np.int32)
        for x, r in rank.items():
            if len(x) == 1:
                self.symbol[ord(x)] = r
        self.symbol_ids = np.array([*map(self.ids_of, rank), 0], np.uint32)
        pairs = [(rank[x[:k]] * (none + 1) + rank[x[k:]], r) for x, r in rank.items() for k in range(1, len(x)) if x[:k] in rank and x[k:] in rank]
        keys, merged = np.array(pairs, np.int64).reshape(-1, 2).T
        bits = max(4 * len(keys), 2).bit_length()
        self.shift, self.slots, self.merged = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, none, np.int32)
        at = self.slot(keys)
        while len(keys):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[free]
            own = self.slots[at] == keys
            self.merged[at[own]] = merged[own]
            keys, merged, at = keys[~own], merged[~own], at[~own] + 1 & len(self.slots) - 1

    def slot(self, keys):
        import numpy as np

        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def pair(self, a, b):
        """The symbol that two symbols merge to, or none."""
        import numpy as np

        keys = a.astype(np.int64) * (len(self.rank) + 1) + b
        at = self.slot(keys)
        found, out = self.slots[at], self.merged[at]
        if len(again := np.flatnonzero(found != keys)):
            out[again] = len(self.rank)
            while len(again := again[found[again] >= 0]):
                at[again] = at[again] + 1 & len(self.slots) - 1
                found[again] = self.slots[at[again]]
                own = found[again] == keys[again]
                out[again[own]] = self.merged[at[again[own]]]
                again = again[~own]
        return out

    def key(self, doc_id) -> int:
        return int.from_bytes(blake2b(f"{self.seed}/{doc_id}".encode(), digest_size=8).digest(), "little")

    def draw(self, keys, at):
        """Gaps of keys by their numbers: candidates that are taken before one is skipped."""
        import numpy as np

        if not self.dropout:
            return np.full(len(at), _NEVER)
        h = at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return len(self.steps) - np.searchsorted(self.steps, h ^ h >> np.uint64(31), "right")

    def gaps(self, key: int, first: int, n: int, step: int = 1) -> list[int]:
        """Gaps first, first + step.. of a key, n of them."""
        import numpy as np

        return self.draw(np.uint64(key), first + step * np.arange(n)).tolist()

    def segment(self, unit: str, gaps) -> tuple[list[str], int, int]:
        """Pieces of a word with endless gaps, how many candidates were skipped, and how many came up after those."""
        n, get, gap, seen, skipped = len(unit), self.rank.get, next(gaps), 0, 0
        end, prev, agenda = list(range(1, n + 1)), list(range(-1, n)), []
        for i in range(n - 1):
            if (r := get(unit[i : i + 2])) is not None:
                agenda.append((r, i, i + 1, i + 2))
        heapify(agenda)
        while agenda:
            _, i, m, e = heappop(agenda)
            if end[i] != m or end[m] != e:
                continue
            if seen == gap:
                gap, seen, skipped = next(gaps), 0, skipped + 1
                continue
            seen += 1
            end[i], end[m] = e, 0
            if e < n:
                prev[e] = i
                if (r := get(unit[i : end[e]])) is not None:
                    heappush(agenda, (r, i, e, end[e]))
            if (p := prev[i]) >= 0 and (r := get(unit[p:e])) is not None:
                heappush(agenda, (r, p, i, e))
        out, i = [], 0
        while i < n:
            out.append(unit[i : end[i]])
            i = end[i]
        return out, skipped, seen

    def alone(self, unit: str, gaps) -> tuple[bytes, int, int]:
        """What segment gives, as ids; a character that is no piece stands as its bytes."""
        found, skipped, seen = self.segment(unit, gaps)
        got = list(map(self.ids_of, found))
        if None in got:
            got = [k for p, x in zip(found, got) for k in ([self.byte[b] for b in p.encode()] if x is None else [x])]
        return array("I", got).tobytes(), skipped, seen

    def cut(self, units: list[str], keys, places, sizes) -> list[tuple[bytes, int, int] | None]:
        """What alone gives for each word with its own gaps: those of its key numbered place, place + size, place + 2 size..

        None for words with characters that are no pieces. A column is a word, a row is a place in it;
        the least of rank and place in a column is the candidate that an agenda would give.
        """
        import numpy as np

        none, n = len(self.rank), len(units)
        lens = np.fromiter(map(len, units), np.int64, n)
        high, word = int(lens.max()), np.repeat(np.arange(n), lens)
        row = np.arange(len(word)) - np.repeat(lens.cumsum() - lens, lens)
        chars = self.symbol[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        # Row high stands for what is before the first place and after the last one.
        syms = np.full((high + 1, n), none, np.int32)
        syms[row, word] = chars
        odd = np.zeros(n, bool)
        odd[word[chars == none]] = True
        after, before = (np.repeat(np.arange(k, k + high + 1, dtype=np.int32)[:, None], n, 1) for k in (1, -1))
        before[0], after[lens - 1, np.arange(n)] = high, high
        bits = high.bit_length()
        end = none << bits
        best = np.full((high + 1, n), end, np.int64)
        if high > 1:
            found = self.pair(syms[:-2].ravel(), syms[1:-1].ravel()).reshape(high - 1, n)
            best[: high - 1] = np.where(found < none, (found.astype(np.int64) << bits) + np.arange(high - 1)[:, None], end)
        gap, seen, skipped = self.draw(keys, places), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live, out = np.arange(n), syms.copy()
        while len(live):
            least = best.min(0)
            if 4 * np.count_nonzero(going := least < end) < 3 * len(going):
                out[:, live[~going]] = syms[:, ~going]
                live, least = live[going], least[going]
                syms, best, before, after = (x[:, going] for x in (syms, best, before, after))
                continue
            at = np.flatnonzero(going)
            i = least[at] & (1 << bits) - 1
            w = live[at]
            skip = seen[w] == gap[w]
            if skip.any():
                best[i[skip], at[skip]] = end
                v = w[skip]
                skipped[v] += 1
                seen[v] = 0
                gap[v] = self.draw(keys[v], places[v] + skipped[v] * sizes[v])
                at, i, w = at[~skip], i[~skip], w[~skip]
            seen[w] += 1
            new = (least[at] >> bits).astype(np.int32)
            m = after[i, at]
            e, p = after[m, at], before[i, at]
            syms[i, at], syms[m, at] = new, none
            after[i, at], before[e, at] = e, i
            best[m, at] = end
            found = self.pair(np.concatenate([new, syms[p, at]]), np.concatenate([syms[e, at], new])).astype(np.int64)
            found = np.where(found < none, (found << bits) + np.concatenate([i, p]), end)
            best[i, at], best[p, at] = found[: len(at)], found[len(at) :]
        out = out.T
        stay = out < none
        ids, ends = self.symbol_ids[out[stay]].tobytes(), (4 * stay.sum(1).cumsum()).tolist()
        return [None if o else (ids[a:b], k, m) for o, a, b, k, m in zip(odd.tolist(), [0, *ends], ends, skipped.tolist(), seen.tolist())]

    def hold(self, unit: str, entry: tuple[int, bytes]) -> None:
        """Put a word into known; half of ROOM makes known the older generation."""
        if self.held >= ROOM // 2:
            self.old.clear()
            self.old.update(self.known)
            self.known.clear()
            self.held = 0
        self.known[unit] = entry
        self.held += 1

    def units(self, text: str) -> list:
        """Words with their mark; None stands for the mark itself as a character of the text."""
        if not text:
            return []
        if _MARK in text:
            out: list = []
            for k, part in enumerate(text.split(_MARK)):
                out += ([None] if k else []) + _RUNS.findall(("" if k else _MARK) + part.replace(" ", _MARK))
            return out
        if "  " in text:
            return _RUNS.findall(_MARK + text.replace(" ", _MARK))
        return (_MARK + text.replace(" ", f" {_MARK}").replace("\n", " \n ")).split(" ") if text[0] != " " else _RUNS.findall(_MARK + text.replace(" ", _MARK))

    def encode(self, text: str, key: int = 0) -> bytes:
        """Ids as native 32-bit unsigned integers; an empty text has none."""
        return self.encode_all([text], [key])[0]

    def encode_all(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Ids of each text by its key; some texts at a time."""
        out: list[bytes] = []
        units: list = []
        sizes: list[int] = []
        for text in texts:
            more = self.units(text)
            units += more
            sizes.append(len(more))
            if len(units) >= TOGETHER:
                out += self._encode(units, sizes, keys[len(out) :])
                units, sizes = [], []
        return out + self._encode(units, sizes, keys[len(out) :])

    def _encode(self, units: list, sizes: list[int], keys: list[int]) -> list[bytes]:
        import numpy as np

        n, keys, out = np.array(sizes, np.int64), np.array(keys[: len(sizes)], np.uint64), []
        ends = n.cumsum()
        for a in range(0, len(units), TOGETHER):
            at = np.arange(a, min(a + TOGETHER, len(units)))
            text = np.searchsorted(ends, at, "right")
            out += self._words(units[a : a + TOGETHER], keys[text], at - (ends - n)[text], n[text])
        return [b"".join(out[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _words(self, units: list, keys, places, n) -> list[bytes]:
        """Ids of words by their text's key, their place in it and its number of words."""
        first, old, todo = self.draw(keys, places).tolist(), self.old, []
        met = list(map(self.known.get, units))
        out = [x[1] if x is not None and gap >= x[0] else None for x, gap in zip(met, first)]
        for k in [k for k, x in enumerate(out) if x is None]:
            unit = units[k]
            if not unit:
                out[k] = self.mark if unit is None else b""
                continue
            if met[k] is None and (x := self.known.get(unit) or old.get(unit)) is not None:
                if unit not in self.known:
                    self.hold(unit, x)
                if first[k] >= x[0]:
                    out[k] = x[1]
                    continue
            todo.append(k)
        todo.sort(key=lambda k: len(units[k]))
        short = sum(len(units[k]) <= KEPT_CHARS for k in todo)
        for a in range(0, len(todo), BLOCK):
            some, few = todo[a : a + BLOCK], todo[a : min(a + BLOCK, short)]
            cut = self.cut([units[k] for k in few], keys[few], places[few], n[few]) if few else []
            for k, got in zip(some, chain(cut, repeat(None))):
                unit = units[k]
                if got is None:
                    key, place, step = int(keys[k]), int(places[k]), int(n[k])
                    got = self.alone(unit, chain.from_iterable(self.gaps(key, place + j * step, 64, step) for j in count(0, 64)))
                out[k], skipped, seen = got
                if not skipped and len(unit) <= KEPT_CHARS and unit not in self.known:
                    self.hold(unit, (seen, out[k]))
        return out

    def decode(self, ids) -> str:
        """The text again: joined pieces less the space put before the first."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


def coder(*args) -> PieceCoder:
    if args not in _CODERS:
        _CODERS[args] = PieceCoder(*args)
    return _CODERS[args]


def _encoder(model: str, dropout: float, seed: int, digest: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = coder(model, dropout, seed)
        for b in batches:
            docs, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            keys = [c.key(d) for d in docs]
            ids = c.encode_all(texts, keys)
            cols = [b.column("doc_id"), pa.array([k >> 33 for k in keys], pa.int32()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if digest:
                back = [c.decode(memoryview(x).cast("I")) for x in ids]
                cols += [pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([x == y for x, y in zip(texts, back)])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "stream", "n_pieces", "ids_crc32", "lossless"])
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array([np.frombuffer(x, np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "stream", "n_pieces", "ids"])

    return run


def _run(docs: DataFrame, run, schema: str, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {schema}")


def encode_pieces(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stream, n_pieces, ids) of every whole text; null and empty texts have no ids.

    stream: the first 31 bits of the document's key, whose 64 all count. Rows with equal ids and texts get equal pieces. Other columns are ignored.
    """
    return _run(docs, _encoder(model, dropout, seed, False), "stream int, n_pieces long, ids array<int>", id_col, text_col)


def decode_pieces(coded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null or empty list gives the empty text."""

    def run(batches):
        import pyarrow as pa

        c = coder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    small_batches(coded.sparkSession)
    rows = coded.select(F.col(id_col).alias("doc_id"), "ids")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def op6_merge_dropout(spark, sf_dir: str) -> DataFrame:
    """Encode every document with dropout, decode it again, and digest both."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _run(docs, _encoder(public_tokenizers.path("piece_bpe_32k.model"), DROPOUT, 0, True), "stream int, n_pieces long, ids_crc32 long, lossless boolean", "doc_id", "text")
