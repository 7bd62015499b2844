"""Whole texts to token ids by the tokenizers library, each distinct word once.

Splitting before words is exact where the tokenizer's own splitter would also
split there, so the ids equal those of encoding the text in one call:

- `blank`: the splitter never joins characters over white space, so a text is
  encoded chunk by chunk between spaces and line feeds;
- `lead`: a word takes its one leading space with it. Texts whose white space
  isn't single spaces and single line feeds between words go through the
  library whole.

A text that holds the string of an added token (`<|endoftext|>`) goes through the
library whole as well, so such a string gets the id that the library gives it.

A word of Latin-1 characters goes to the library's model, split as the
tokenizer's pattern says; any other word goes through its whole pipeline. A full
stop or comma that ends a word is a piece of its own, and so it is looked up by
itself, in texts where none follows another sign.
Texts are taken in slices of SLICE characters. Arrow splits a slice, numbers its
distinct words, finds those that the worker knows and lays their ids out; only new
words meet Python. A worker's words and their ids are kept in arrays: when these
hold HELD bytes, half of them stay, the words that most slices have met lately and
then the newest. Ids of words' pieces are kept in two generations:
when the younger holds half of ROOM bytes it becomes the older, and what is met
again moves back. One vocabulary is kept at a time, so HELD and ROOM bound a
worker's tables whatever the corpus; results never depend on them.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

#: Bytes that the pieces of a worker may take, keys, values and slots.
ROOM = 32 << 20
#: Bytes of the arrays of a worker's words and their ids.
HELD = 16 << 20
#: Bytes of an entry beside its characters and ids: two object heads and a slot with its share of free ones. Longer words than LONGEST aren't kept.
ENTRY, LONGEST = 190, 48
#: Characters of the texts that are looked up together; a longer text is a slice of its own.
SLICE = 4 << 20
#: In `lead` mode a word without this mark has a space before it.
_MARK = "\x01"
_BREAK, _SPACES = f" \n {_MARK}", (" ", "\n")
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_TAIL = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\\s{_LETTER}{_DIGIT}]+|\\s"
_LEAD = re.compile(_TAIL)
_BLANK = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
#: Characters that the patterns above and the library treat alike, white space and controls left out.
_PLAIN = re.compile("[\\n\x20-\x7e\xa1-\xac\xae-\xff]*").fullmatch
#: A stop or comma after anything but a letter or digit, where it may belong to that sign's piece.
_JOINED = re.compile("[^A-Za-z0-9À-ÖØ-öø-ÿ][.,]").search
_ENDS = tuple((f"{x}{y}", f" {_MARK}{x}{y}", f" {x}{y}") for x in ",." for y in " \n")
_CODERS: dict = {}


class Kept(dict):
    """What make(word) gives, kept in two generations of half of `room` bytes each."""

    def __init__(self, make, room: int | None = None):
        super().__init__()
        self.make, self.half, self.held, self.old = make, (ROOM if room is None else room) // 2, 0, {}

    def __missing__(self, word):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
            if len(word) > LONGEST:
                return out
        self.held += len(word) + len(out) + ENTRY
        if self.held > self.half:
            self.old, self.held = dict(self), 0
            self.clear()
        self[word] = out
        return out


class Words:
    """Distinct words and their ids in arrays of up to `room` bytes."""

    def __init__(self, room: int | None = None):
        import numpy as np
        import pyarrow as pa

        self.room = HELD if room is None else room
        self.words, self.coded, self.met = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.int32)

    def ids(self, words, make):
        """What make(word) gives for each of `words`, an array without repeats."""
        import numpy as np
        import pyarrow as pa
        from pyarrow import compute

        at = compute.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().copy()
        self.met[at[at >= 0]] += 1
        at[at < 0] = np.arange(len(self.words), len(self.words) + len(new))
        made = pa.array(list(map(make, new.to_numpy(zero_copy_only=False).tolist())), pa.large_binary())
        n = len(self.words)
        self.words, self.coded = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.coded, made])
        out = self.coded.take(pa.array(at))
        short = compute.less_equal(compute.utf8_length(new), LONGEST).to_numpy(zero_copy_only=False)
        if not short.all():
            kept = pa.array(np.concatenate([np.arange(n), n + np.flatnonzero(short)]))
            self.words, self.coded = self.words.take(kept), self.coded.take(kept)
        self.met = np.concatenate([self.met, np.zeros(len(self.words) - len(self.met), np.int32)])
        if self.words.nbytes + self.coded.nbytes > self.room:
            self._forget()
        return out

    def _forget(self) -> None:
        import numpy as np
        import pyarrow as pa

        sizes = 16 + sum(np.diff(np.frombuffer(x.buffers()[1], np.int64, len(x) + 1)) for x in (self.words, self.coded))
        order = np.lexsort((-np.arange(len(sizes)), -self.met))
        kept = np.sort(order[np.cumsum(sizes[order]) <= self.room // 2])
        self.words, self.coded, self.met = self.words.take(pa.array(kept)), self.coded.take(pa.array(kept)), self.met[kept] // 2


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Coder:
    def __init__(self, path: str, split: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lead = split == "lead"
        self.make = self._leading() if self.lead else self._blank()
        self.pieces = Kept(self.make)
        self.get = self.pieces.__getitem__
        self.words = Words()

    def _model(self):
        """Ids of one piece of Latin-1 characters, as the splitter leaves it; ids of a word of ASCII letters after a space."""
        tokenize, stand_in = self.tokenizer.model.tokenize, _byte_chars()
        space = stand_in[32]

        def model(piece: str) -> bytes:
            if not piece.isascii():
                piece = piece.encode().decode("latin1").translate(stand_in)
            elif not piece.isalpha():
                piece = piece.translate(stand_in)
            return array("I", [t.id for t in tokenize(piece)]).tobytes()

        def spaced(word: str) -> bytes:
            return array("I", [t.id for t in tokenize(space + word)]).tobytes()

        return model, spaced

    def _leading(self):
        """Ids of a word: one without _MARK stands for itself and the space before it."""
        (model, spaced), library = self._model(), self.library

        def piece(found: str) -> bytes:
            return self.get(found if found == "\n" else found[1:] if found[0] == " " else _MARK + found)

        def make(unit: str) -> bytes:
            if unit.isascii() and unit.isalpha():
                return spaced(unit)
            if unit in ("", _MARK):
                return b"" if unit else model(" ")
            word = unit if unit == "\n" else unit[1:] if unit[0] == _MARK else " " + unit
            if unit.isascii() and unit[0] == _MARK and word.isalpha():
                return model(word)
            if not _PLAIN(word):
                return library([word])[0]
            pieces = _LEAD.findall(word)
            return model(word) if len(pieces) == 1 else b"".join(map(piece, pieces))

        return make

    def _blank(self):
        """Ids of a word between spaces."""
        (model, _), library = self._model(), self.library

        def make(unit: str) -> bytes:
            if unit.isascii() and unit.isalpha():
                return model(unit.lower())
            if not _PLAIN(unit):
                return library([unit])[0]
            pieces = _BLANK.findall(unit.lower())
            return model(pieces[0]) if len(pieces) == 1 else b"".join(map(self.get, pieces))

        return make

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd(self, t: str) -> bool:
        """Whether a text's white space is anything but single spaces and line feeds between words."""
        return "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[:1] in _SPACES or t[-1:] in _SPACES or not t.replace("\n", "").isprintable()

    def _looked_up(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose words stand between single spaces; every distinct word is looked up once."""
        import numpy as np
        import pyarrow as pa
        from pyarrow import compute

        lists = compute.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        ids = self.words.ids(coded.dictionary, self.make).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1)[lists.offsets.to_numpy()].tolist()
        data = memoryview(data) if data else b""
        return [bytes(data[s:e]) for s, e in zip(ends[:-1], ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as native 32-bit unsigned integers."""
        added, out, at, ready, held = self.added, [b""] * len(texts), [], [], 0
        for k, t in enumerate(texts):
            if any(x in t for x in added) or self.lead and self._odd(t):
                (out[k],) = self.library([t])
                continue
            if held and held + len(t) > SLICE:
                for j, ids in zip(at, self._looked_up(ready)):
                    out[j] = ids
                at, ready, held = [], [], 0
            if not _JOINED(t):
                for end, marked, plain in _ENDS:
                    t = t.replace(end, marked if self.lead else plain)
            at.append(k)
            ready.append((_MARK + t).replace("\n", _BREAK) if self.lead else t.replace("\n", " "))
            held += len(t)
        if ready:
            for j, ids in zip(at, self._looked_up(ready)):
                out[j] = ids
        return out

    def encode_batches(self, batches):
        """(batch, ids of its texts) of each batch with a column `text` (null: empty), read a slice at a time."""
        got, held = [], 0
        for b in batches:
            got.append(b)
            held += b.column("text").nbytes
            if held >= SLICE:
                yield from self._coded(got)
                got, held = [], 0
        yield from self._coded(got)

    def _coded(self, got):
        ids = iter(self.encode([t or "" for b in got for t in b.column("text").to_pylist()]))
        for b in got:
            yield b, list(islice(ids, b.num_rows))


def coder(path: str, split: str) -> Coder:
    """One per worker process, of the vocabulary asked for last."""
    if (path, split) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, split] = Coder(path, split)
    return _CODERS[path, split]


def small_batches(spark, rows: int = 256) -> None:
    """Whole texts can be long: Arrow batches to Python hold few rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
