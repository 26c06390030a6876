"""Whole-text token ids by the tokenizers library, one call for each distinct piece of text.

Both tokenizers split a text before they merge, and never merge over certain places beside white
space.  A text is therefore cut at such places, each distinct piece is encoded once by
the library, and the ids are joined.  Texts in which a cut could fall inside a unit (long runs of
white space, strings of special tokens) go to the library whole.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores

import public_tokenizers
from tokenizers import Tokenizer

#: White space in Unicode's wider sense, as UTF-8, and the start of special strings; such pieces are never remembered.
ODD = re.compile(rb"[\t\x0b-\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")
#: A cut before a blank or line feed inside white space is safe only if it is the last one before a word.
UNSAFE = re.compile(rb"[ \n][ \n](?:[ \n]|$)")

#: Letters of ASCII and Latin-1 in UTF-8, and ASCII marks.
LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the
#: others take the code points from 256 on, in order.
BYTE_CHARS = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 512)))


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


class WordIds(dict):
    """Ids of words under a tokenizer that drops white space, encoded when they are first asked for."""

    def __init__(self, encoder: "PieceEncoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: bytes) -> bytes:
        encoder, bare = self.encoder, word.rstrip(MARKS)
        if bare.isalpha() or LATIN.fullmatch(bare):
            ids = self[bare] + encoder.tail(word[len(bare):]) if len(bare) < len(word) else encoder.word(word, True)
        else:
            ids, = encoder.whole([word])
            if ODD.search(word):
                return ids
        self[word] = ids
        return ids


class PieceEncoder:
    """Encodes texts given as UTF-8 bytes to little-endian unsigned 32-bit ids.

    ``drops_space``: the tokenizer drops white space, so any ASCII white space is a cut; else
    (byte-level) a piece starts with the blank or line feed before its word, and its key leaves out the blank.
    ``cache_size`` bounds the pieces remembered in a Python worker: beyond it only those of the last batch stay.
    """

    def __init__(self, path: str, drops_space: bool, cache_size: int = 1_000_000):
        self.library = Tokenizer.from_file(path)
        self.drops_space, self.cache_size = drops_space, cache_size
        self.cache: dict[bytes, bytes] = {}
        self.model = self.library.model
        self.feed, = self.whole([b"\n"])
        self.tails: dict[bytes, bytes] = {}
        self.words = WordIds(self)

    def whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([str(t, "utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def cuts(self, text: bytes) -> list[bytes]:
        """Keys of the pieces of a text; the byte-level kind's first piece is apart (``head``)."""
        if self.drops_space:
            # A-Z are lower-cased early, unless a special string or a combining accent (U+0300-U+033F) is near
            return (text if b"<|" in text or b"\xcc" in text else text.lower()).split()
        return text.replace(b"\n", b" \n").split(b" ")[1:]

    def head(self, text: bytes) -> bytes:
        """The first piece of the byte-level kind: what stands before the first blank or line feed."""
        return re.split(rb"[ \n]", text, maxsplit=1)[0]

    def word(self, letters: bytes, blank: bool) -> bytes:
        """Ids of a run of Latin letters, which is one unit of the tokenizer's merges."""
        if self.drops_space:
            letters = letters.lower() if letters.isascii() else letters.decode().lower().encode()
        unit = letters.decode() if letters.isascii() else letters.decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize("\u0120" + unit if blank and not self.drops_space else unit)]).tobytes()

    def tail(self, marks: bytes) -> bytes:
        """Ids of a run of ASCII marks behind a letter, a unit of its own."""
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[marks], = self.whole([marks])
        return self.tails[marks]

    def learn(self, missing: set[bytes]) -> set[bytes]:
        """Encode and remember new pieces; returns those that are no plain words.

        Letters with marks behind them go straight to the library's merges, unit by unit; so does a word after a
        line feed.  All else goes through the whole library.
        """
        cache, odd, other = self.cache, set(), []
        for k in missing:
            bare = k.rstrip(MARKS)
            if (bare.isalpha() or LATIN.fullmatch(bare)) and b"<|" not in k:
                if bare not in cache:
                    cache[bare] = self.word(bare, True)
                if bare is not k:
                    cache[k] = cache[bare] + self.tail(k[len(bare):])
            elif not k or k == b"\n" or ODD.search(k):
                odd.add(k)
            elif bare[:1] == b"\n" and bare[1:].isalpha():
                cache[k] = self.feed + self.word(bare[1:], False) + (self.tail(k[len(bare):]) if len(bare) < len(k) else b"")
            else:
                other.append(k)
        cache.update(zip(other, self.whole([k if k[:1] == b"\n" else b" " + k for k in other])))
        return odd

    @staticmethod
    def gaps(found: list) -> list[int]:
        out, i = [], -1
        try:
            while True:
                i = found.index(None, i + 1)
                out.append(i)
        except ValueError:
            return out

    def encode_words(self, texts: list[bytes]) -> list[bytes]:
        """For tokenizers that drop white space: words are encoded one by one, but for texts with special strings."""
        ids = self.words.__getitem__
        out = [self.whole([t])[0] if b"<|" in t else b"".join(map(ids, self.cuts(t))) for t in texts]
        if len(self.words) > self.cache_size:
            self.words.clear()
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.drops_space:
            return self.encode_words(texts)
        get = self.cache.get
        pieces = [self.cuts(t) for t in texts]
        found = [list(map(get, p)) for p in pieces]
        gaps = [self.gaps(f) for f in found]
        odd = self.learn({p[i] for p, g in zip(pieces, gaps) for i in g})
        heads = self.whole([self.head(t) for t in texts])
        whole, out, at = [], [], self.cache.__getitem__
        for text, p, f, g, head in zip(texts, pieces, found, gaps, heads):
            if odd and any(p[i] in odd for i in g) or ODD.search(self.head(text)):
                if ODD.search(text) or UNSAFE.search(text):
                    out.append(None)
                    whole.append(text)
                    continue
                own = [k for k in {p[i] for i in g} if k in odd]
                own = dict(zip(own, self.whole([k if k[:1] == b"\n" else b" " + k for k in own])))
                for i in g:
                    f[i] = own[p[i]] if p[i] in own else at(p[i])
            else:
                for i in g:
                    f[i] = at(p[i])
            out.append(head + b"".join(f))
        rest = iter(self.whole(whole))
        if len(self.cache) > self.cache_size:
            self.cache = {k: self.cache[k] for k in set(itertools.chain.from_iterable(pieces)) if k in self.cache}
        return [next(rest) if x is None else x for x in out]


_ENCODERS: dict[tuple, PieceEncoder] = {}


def worker_encoder(path: str, drops_space: bool, cache_size: int = 1_000_000) -> PieceEncoder:
    """One encoder for each Python worker process, kept between its tasks."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, drops_space, cache_size)
    return _ENCODERS[key]
