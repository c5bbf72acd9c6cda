"""Words of whole texts: their token ids, and their hashes.

A tokenizer that drops white space never joins across it, so a text's ids are its words' ids in order. Words
repeat far more than texts do, so each distinct word of some MB of texts is looked up once, and each worker remembers
the ids of recent pieces of words.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Letters up to ÿ, then ASCII that begins with no letter: no rule of a tokenizer that splits at letters looks across.
CUT = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<rest>(?:[\x00-@\[-`{-\x7F][\x00-\x7F]*)?)$"
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BYTES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else the next free one."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds(dict):
    """Little-endian unsigned 32-bit ids of the words of whole texts. Arrow cuts texts into words and numbers the distinct
    ones; of these only the distinct pieces come to Python. A piece is the letters a word begins with, lower-cased, or
    the rest of it, or a whole word that can't be cut there. Of recent pieces, `most` to twice as many are kept, besides
    those of the texts at hand: some 80 MB a worker, however many words a corpus has."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}
        self.written = _byte_letters()
        if self._encode("a b\n c") != self._encode("a") + self._encode("b") + self._encode("c"):
            raise ValueError("the tokenizer keeps white space; its texts can't be encoded word by word")
        # whether plain words skip the normalizer and the splitter: case is folded, and bytes are written as letters
        tests = ("q", "über", "straße", "niño", "tokenization", "éàç")
        self.direct = self._encode("Q") == self._encode("q") and all(self._model(t) == self._encode(t) for t in tests)
        # and whether a word may be cut where its first letters end
        self.direct &= all(self._encode("q" + r) == self._encode("q") + self._encode(r) for r in (".", "'s", "'", ",$$$", "-q", "4q", "\x00", "@q.q"))

    def _encode(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _model(self, word: str) -> bytes:
        # ASCII letters are written as they are
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self.written)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            # letters up to ÿ lower-case alike everywhere and are composed already
            plain = self.direct and piece.isalpha() and (piece.isascii() or max(piece) <= "ÿ")
            ids = self._model(piece.lower()) if plain else self._encode(piece)
        self[piece] = ids
        return ids

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece."""
        pieces = pieces.dictionary_encode()
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        ids = list(map(self.__getitem__, pieces.dictionary.to_pylist()))
        return pa.array(ids, pa.large_binary()).take(pieces.indices)

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each word."""
        if not self.direct:
            return self._pieces(words)
        cut = pc.extract_regex(words, CUT)
        stem = pc.if_else(cut.is_valid(), pc.utf8_lower(cut.field("stem")), words)
        rest = pc.if_else(cut.is_valid(), cut.field("rest"), "")
        return pc.binary_join_element_wise(self._pieces(stem), self._pieces(rest), pa.scalar(b"", pa.large_binary()))

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null has none. Arrow's ASCII white space is exactly the contracts' six characters."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        ids = self._words(coded.dictionary).take(coded.indices)
        # what is taken lies in one buffer, word after word
        at = np.r_[0, np.cumsum(pc.binary_length(ids).to_numpy())]
        at = at[np.r_[0, np.cumsum(words.value_lengths().to_numpy())]].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in pairwise(at)]

    def text(self, text: bytes) -> bytes:
        return self.texts(pa.array([text.decode()]))[0]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process and tokenizer file."""
    return WordIds(path)


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """Ids of tokens that end a sentence."""
    vocab = word_ids(path).tokenizer.get_vocab()
    return np.array(sorted(i for t, i in vocab.items() if t.removesuffix("</w>") in {".", "!", "?", "...", '."', '?"', '!"'} and t.endswith("</w>")), "<u4")


class WordHashes(dict):
    """A 64-bit hash of each word of a text, lower-cased and without ASCII signs. Forgets all at `most` words, some
    20 MB a worker."""

    def __init__(self, most: int = 120_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out

    def text(self, text: str | None) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        words = (text or "").lower().encode().translate(WORD_BYTES).split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def running_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2 ** 64, of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * BASE + words[j : j + n]
    return out
