"""Encoding of whole texts in Spark tasks through a cache of white-space-separated pieces."""

from __future__ import annotations

import json
import re
from array import array

#: Pieces, and words of letters, that a worker keeps in each of two generations; the longest piece in bytes: about 200 MB at most.
ROOM, LONGEST = 250_000, 64
#: Bytes of texts whose new pieces are learnt together, about.
SLICE = 1 << 13
#: Letters of ASCII and Latin-1 as UTF-8, and marks that may follow them: two pre-tokens, each encoded alone.
_LETTERS, _MARKS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"), b".,;:!?$%&#*|<>)]"

_encoders: dict[tuple, "Encoder"] = {}


def separable(path: str) -> bool:
    """Whether the tokenizer file drops white space before it splits, so that pieces between white space encode alone."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm = json.dumps(spec.get("normalizer") or {})
    split = json.dumps(spec.get("pre_tokenizer") or {})
    # letters are looked up in lower case, so the tokenizer must make no difference either
    return '"Lowercase"' in norm and "\\\\s+" in norm and "[^\\\\s" in split and '" ?' not in split and "add_prefix_space\": true" not in split


def _word_ends(path: str, model) -> bytes:
    """For each id whether it ends a word, as the file marks them; empty where it marks none."""
    with open(path, encoding="utf-8") as f:
        mark = json.load(f)["model"].get("end_of_word_suffix")
    if not mark:
        return b""
    vocabulary = model.get_vocab()
    out = bytearray(max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = token.endswith(mark)
    return bytes(out)


class Encoder:
    """Text (UTF-8) to its token ids as little-endian unsigned 32-bit bytes, or to their number.

    Pieces between white space are looked up; unknown ones ask the library, after letters and punctuation are taken apart
    and ASCII letters are lowered. The table has two generations: a full one becomes the old one, whose pieces come back
    when they are used. Pieces of a text are learnt together, so one text may pass the bound by its own words.
    """

    def __init__(self, path: str, count: bool = False, known: dict | None = None, room: int = ROOM):
        self.known, self.room, self.whole, self.count = known or {}, room, not separable(path), count
        self.now, self.old, self.words, self.older, self.long = dict(self.known), {}, {}, {}, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ask = lambda s: model.encode(s)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            self.model, self.ask = model, lambda s: model.encode(s, add_special_tokens=False).ids
            self.ends = _word_ends(path, model)

    def _fold(self, ids):
        return len(ids) if self.count else array("I", ids).tobytes()

    def _words(self, words: list[bytes]) -> None:
        """Add lower-case words of letters, encoded as one text, which costs a fraction of a call each."""
        text = b" ".join(words).decode()
        ids = self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids if self.ends else []
        flat, ends = array("I", ids).tobytes(), self.ends
        starts = [0, *(i for i, x in enumerate(ids, 1) if ends[x])]
        if len(starts) != len(words) + 1 or starts[-1] != len(ids):  # a vocabulary that doesn't mark words' ends
            got = self.model.encode(text, add_special_tokens=False)
            of, ids = got.word_ids, got.ids
            starts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(ids)]
            flat = array("I", ids).tobytes()
        for w, i, j in zip(words, starts, starts[1:]):
            self.words[w] = j - i if self.count else flat[4 * i : 4 * j]

    def _learn(self, pieces) -> None:
        """Add the pieces: letters, then punctuation; what is neither goes to the library as it is."""
        now, old, words, older = self.now, self.old, self.words, self.older
        known = old.keys() & pieces
        now.update((p, old[p]) for p in known)
        pieces = [*pieces.difference(known)] if known else [*pieces]
        lows = b" ".join(pieces).lower().split(b" ") if pieces else []
        cores = [w.rstrip(_MARKS) for w in lows]
        odd = [p for p, core in zip(pieces, cores) if len(p) > LONGEST or not (core.isalpha() or _LETTERS.fullmatch(core))]
        if odd:
            for p in odd:
                now[p] = self._fold(self.ask(p.decode("utf-8", "replace")))
                if len(p) > LONGEST:
                    self.long.append(p)
            some = set(odd)
            pieces, lows, cores = map(list, zip(*[x for x in zip(pieces, lows, cores) if x[0] not in some])) if len(some) < len(pieces) else ([], [], [])
        new = {*cores}.difference(words)
        back = older.keys() & new
        words.update((w, older[w]) for w in back)
        if new := [*new.difference(back)]:
            self._words(new)
        rests = [low[len(core) :] for low, core in zip(lows, cores)]
        for rest in {*rests}.difference(words, (b"",)):
            words[rest] = self._fold(self.ask(rest.decode()))
        words[b""] = 0 if self.count else b""
        now.update((p, words[core] + words[rest]) for p, core, rest in zip(pieces, cores, rests))
        if len(words) > self.room:
            self.older, self.words = words, {}

    def _values(self, text: bytes):
        for p in self.long:
            del self.now[p]
        self.long = []
        words = text.split()
        own = set(words)
        if new := own.difference(self.now):
            if len(self.now) + len(new) > self.room:
                self.old, self.now = self.now, dict(self.known)
                new = own.difference(self.now)
            self._learn(new)
        return map(self.now.__getitem__, words)

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text, four bytes each."""
        if self.whole:
            return array("I", self.ask(text.decode("utf-8", "replace"))).tobytes()
        return b"".join(self._values(text))

    def encode_all(self, all_texts: list[bytes]) -> list[bytes]:
        """The ids of several whole texts; what is new in about SLICE bytes of them is learnt together."""
        if self.whole:
            return [self.encode(t) for t in all_texts]
        out, own, size = [], [], 0
        for i, t in enumerate(all_texts):
            own.append(t.split())
            size += len(t)
            if size >= SLICE or i + 1 == len(all_texts):
                for p in self.long:
                    del self.now[p]
                self.long = []
                some = set().union(*own)
                new = some.difference(self.now)
                if new and len(self.now) + len(new) > self.room:
                    self.old, self.now = self.now, dict(self.known)
                    new = some.difference(self.now)
                if new:
                    self._learn(new)
                get = self.now.__getitem__
                out += [b"".join(map(get, w)) for w in own]
                own, size = [], 0
        return out

    def length(self, text: bytes) -> int:
        """The number of ids of a whole text, for an encoder that counts."""
        if self.whole:
            return len(self.ask(text.decode("utf-8", "replace")))
        return sum(self._values(text))


def encoder(path: str, count: bool = False, known: dict | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; it lasts as long as the worker."""
    key = (path, count, hash(frozenset(known.items())) if known else 0)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, count, known)
    return _encoders[key]


def texts(column) -> list[bytes]:
    """An Arrow column of strings as UTF-8 bytes, nulls as empty texts."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
