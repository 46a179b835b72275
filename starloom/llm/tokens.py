"""Public tokenizers applied to distinct words.

A text is cut where no token can reach across, each distinct piece of a slice is encoded by the
library once, and the ids of all pieces are gathered with numpy. Results equal the library's on
whole texts (the tests compare them). Caches have a fixed size, so a task's memory is bounded.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from starloom.llm.text import IS_SPACE, packed_words, ragged

#: Pieces of a cache's generation. A task holds two generations of one tokenizer.
CACHE = 120_000


def default(name: str) -> str:
    """The place of an installed public vocabulary; every operator also takes another path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(coded: pa.DictionaryArray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of dictionary-encoded words, and the number of ids before each, from the ids of the dictionary's words and their numbers."""
    code = coded.indices.to_numpy(zero_copy_only=False)
    lengths = sizes[code]
    before = np.zeros(len(code) + 1, dtype=np.int64)
    np.cumsum(lengths, out=before[1:])
    return flat[ragged((np.cumsum(sizes) - sizes)[code], lengths)], before


class WordCache:
    """Ids by distinct piece. `encode_new` gets pieces and returns their ids as int32 bytes.

    Two generations of at most `limit` pieces: pieces in use move to the younger, the older one goes.
    """

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], limit: int = CACHE):
        self.encode_new, self.limit, self.young, self.old = encode_new, limit, {}, {}

    def lookup(self, pieces: list[str]) -> list[bytes]:
        if len(self.young) + len(pieces) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for p in pieces:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
        if new:
            young.update(zip(new, self.encode_new(new)))
        return [young[p] for p in pieces]

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids of all texts, and where each text's ids begin (one more entry than texts)."""
        ids, before = self.encode_pieces(data, starts, ends)
        return ids, before[at]

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids, and the number of ids before each piece (one more entry than pieces)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return self.gather(packed_words(data, starts, ends).dictionary_encode())

    def gather(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """encode_pieces of words that are dictionary-encoded already."""
        return self._gathered(coded, self.lookup(coded.dictionary.to_pylist()))

    @staticmethod
    def _gathered(coded: pa.DictionaryArray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return gathered(coded, np.frombuffer(b"".join(blobs), np.int32), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4)


class _WordBpe:
    """Words of the lower-casing word-end BPE. Plain Latin words are lower-cased and cut into pre-tokens here, all at once, and go to
    the library's merge model, or to a quicker library where ids follow the merges; others go through the library's whole pipeline.

    The quicker library joins neighbours that together are a token, lowest id first. With a token's end of word spelled as a space these are
    the model's merges, as its tokens are the only way to spell themselves (tested for all of the public vocabulary)."""

    plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
    pre = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
    lines = re.compile(r"[\n!-~À-ÖØ-öø-ÿ]*")
    end = "</w>"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}
        self.ranks = self._ranks(path, {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)})
        self.quick = None
        if self.ranks:
            import tiktoken

            # a pre-token and its end, or the end of a word
            self.quick = tiktoken.Encoding("word_ends", pat_str=r"[^ \n]+ |\n", mergeable_ranks=self.ranks, special_tokens={})
            self.line = self.ranks[b"\n"]

    def _ranks(self, path: str, byte: dict[str, int]) -> dict[bytes, int] | None:
        """Ids by bytes, if every merge makes the id that follows the one before: those of bytes, of bytes that end a word, of merges."""
        with open(path, "rb") as f:
            model = json.load(f)["model"]
        vocabulary, end = model.get("vocab"), model.get("end_of_word_suffix")
        if end != self.end or not isinstance(vocabulary, dict) or model.get("ignore_merges") or model.get("dropout"):
            return None
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", ())]
        cut = {t: t.removesuffix(end) for t in vocabulary}
        singles = sorted(i for t, i in vocabulary.items() if len(cut[t]) == 1 and cut[t] in byte and i < 512)
        if singles != [*range(512)] or [vocabulary.get(m) for m in merges] != [*range(512, 512 + len(merges))] or len(vocabulary) != 512 + len(merges):
            return None
        if not all(c in byte for t in cut.values() for c in t) or not all(vocabulary.get(c, 256) < 256 <= vocabulary.get(c + end, 0) for c in byte):
            return None
        ranks = {bytes(byte[c] for c in cut[t]) + b" " * (t != cut[t]): i for t, i in vocabulary.items()}
        return ranks if len(ranks) == len(vocabulary) else None

    def many(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids of all words, one after another, and the number of each word's. Words are not empty and hold no white space of ASCII."""
        if self.quick is None:
            blobs = self(words.to_pylist())
            return np.frombuffer(b"".join(blobs), np.int32), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        # a word is a line, a pre-token has a space behind it
        joined, odd = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), "\n")[0].as_py(), []
        if "<|" in joined or not self.lines.fullmatch(joined):
            kept = words.to_pylist()
            odd = [k for k, w in enumerate(kept) if "<|" in w or not self.plain.fullmatch(w)]
            others = [self.tokenizer.encode(kept[k], add_special_tokens=False).ids for k in odd]
            for k in odd:
                kept[k] = ""
            joined = "\n".join(kept)
        found = self.quick.encode_to_numpy(" ".join(self.pre.findall(joined.lower() + "\n")), disallowed_special=()).astype(np.int32)
        last = np.flatnonzero(found == self.line)
        sizes, ids = np.diff(last, prepend=-1) - 1, found[found != self.line]
        if odd:
            before = np.concatenate([[0], np.cumsum(sizes)])
            sizes[odd] = [len(x) for x in others]
            ids = np.insert(ids, np.repeat(before[odd], sizes[odd]), np.array([i for x in others for i in x], dtype=np.int32))
        return ids, sizes

    def __call__(self, words: list[str]) -> list[bytes]:
        out = []
        tokenize, find, plain, alphabet = self.tokenizer.model.tokenize, self.pre.findall, self.plain.fullmatch, self.alphabet
        for w in words:
            if w.isascii() and w.isalpha():
                ids = [t.id for t in tokenize(w.lower())]
            elif plain(w) and "<|" not in w:
                parts = find(w.lower())
                if not w.isascii():
                    parts = [p.encode().decode("latin-1").translate(alphabet) for p in parts]
                ids = [t.id for p in parts for t in tokenize(p)]
            else:
                ids = self.tokenizer.encode(w, add_special_tokens=False).ids
            out.append(array("i", ids).tobytes())
        return out


class WordTable:
    """Ids of words; each distinct word of a slice is encoded, and none is kept, so memory is a slice's. Slices of `SLICE` bytes have
    three quarters of the distinct words of slices a quarter as long."""

    SLICE = 4_000_000

    def __init__(self, model: _WordBpe):
        self.model = model

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids of all texts, cut into words at white space, and where each text's ids begin (one more entry than texts)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        offsets, body = np.concatenate([[0], np.cumsum(ends - starts)]), data[~IS_SPACE[data]]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body)) if len(body) == offsets[-1] else packed_words(data, starts, ends)
        coded = words.dictionary_encode()
        flat, sizes = self.model.many(coded.dictionary)
        ids, before = gathered(coded, flat, sizes)
        return ids, before[at]


#: The one table a worker holds; another tokenizer's replaces it, so stages that share workers do not add up.
_held: dict[tuple, object] = {}


def held(kind: Callable, path: str | tuple[str, ...]):
    """kind(path), made once and kept until another is asked for."""
    if (kind, path) not in _held:
        _held.clear()
        _held[kind, path] = kind(path)
    return _held[kind, path]


def _word_table(path: str) -> WordTable:
    return WordTable(_WordBpe(path))


def word_bpe(path: str) -> WordTable:
    """For texts cut at white space: equals encode(text, add_special_tokens=False) of the whole text."""
    return held(_word_table, path)


class _Pieces(WordCache):
    """Each word by itself, with the word mark in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        shown = [self.model.id_to_piece(i).replace("\u2581", "") for i in range(size)]
        #: Pieces that spell words (bytes and vowel signs too), with their characters, and those of symbols alone; bare word marks are neither.
        self.is_word = self.is_byte | np.array([any(c.isalnum() or unicodedata.category(c)[0] == "M" for c in p) for p in shown])
        self.is_symbol = ~self.is_word & np.array([p != "" for p in shown])
        lead = [not 0x80 <= int(p[3:5], 16) < 0xC0 if b else len(p) for p, b in zip(shown, self.is_byte)]
        self.word_length = np.where(self.is_word, np.array(lead, dtype=np.int64), 0)
        super().__init__(lambda new: [array("i", x).tobytes() for x in self.model.encode(new, num_threads=1)])


class _ManyBytes(WordCache):
    """Each word by itself, with a space in front, in the byte-level vocabulary of many languages."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coding = tiktoken.Encoding("many", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def whole(token: bytes) -> bool:
            try:
                token.decode()
            except UnicodeDecodeError:
                return False
            return True

        #: Tokens that are parts of characters, as a byte fallback's are.
        self.is_byte = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.is_byte[[r for t, r in ranks.items() if not whole(t)]] = True
        super().__init__(lambda new: [array("i", coding.encode_ordinary(" " + w)).tobytes() for w in new])


class Fertility(WordCache):
    """The two vocabularies that measure fertility, with one cache of (ids, ids) by word."""

    def __init__(self, paths: tuple[str, str]):
        self.pieces, self.many = _Pieces(paths[0]), _ManyBytes(paths[1])
        super().__init__(lambda new: list(zip(self.pieces.encode_new(new), self.many.encode_new(new))))

    def gather_both(self, coded: pa.DictionaryArray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """gather() in each vocabulary."""
        first, second = zip(*self.lookup(coded.dictionary.to_pylist()))
        return self._gathered(coded, first), self._gathered(coded, second)


def fertility(pieces: str, many: str) -> Fertility:
    return held(Fertility, (pieces, many))
