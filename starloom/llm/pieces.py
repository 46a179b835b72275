"""Offset-preserving SentencePiece encoding and decoding.

Normalisation replaces, from left to right, the longest prefix that the model's compiled character
map knows (a double-array trie of replacements) and records for every byte it emits which source
byte it came from; the space mark, the dummy prefix and dropped spaces are recorded alike. Each
piece of the encoding then projects to an interval of source bytes.

Encoding cuts the normalised text where no piece of the vocabulary can reach across (before a run
of spaces, and around bytes that no longer piece holds), encodes each distinct unit once with the
library, and gathers. Texts with the space mark itself or NUL go to the library whole.

Defined results: null text is empty; an empty text has the end id alone; its decoding is empty.
"""

from __future__ import annotations

import hashlib
import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from starloom.llm import tokens
from starloom.llm.frames import add_struct
from starloom.llm.text import buffers, strings

SPACE = "▁".encode()


class CharMap:
    """A compiled character map: four bytes of trie size, the trie's units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at this place and what replaces it."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & ((1 << 31) | 0xFF) != data[k]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & ((1 << 31) - 1)
                found = (k + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return found


class Model:
    """A SentencePiece model with its normaliser spelled out."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.user = sorted((p.piece.encode() for p in proto.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        self.end = self.lib.eos_id()
        pieces = [p.piece.encode() for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        byte = proto.SentencePiece.BYTE
        normal = proto.SentencePiece.NORMAL
        #: Bytes of normalised text that each id covers.
        self.size = np.array([1 if k == byte else len(p) if k in (normal, proto.SentencePiece.USER_DEFINED) else 0 for p, k in zip(pieces, kinds)], dtype=np.int64)
        long_ = [p for p, k in zip(pieces, kinds) if k == normal and len(p.decode()) > 1]
        inner = {b for p in long_ for b in p}
        self.solitary = np.zeros(256, dtype=bool)
        self.solitary[[b for b in range(1, 128) if b not in inner and b != 32]] = True
        self.splits = bool(self.solitary[10]) and self.escape and self.dummy and not self.user and not self.squeeze and not self.map.units and proto.trainer_spec.byte_fallback and all(SPACE not in p.lstrip(b"\xe2\x96\x81") for p in long_ if not p.replace(SPACE, b"") == b"") and not proto.trainer_spec.treat_whitespace_as_suffix
        self.lead = len(self.lib.encode("\n"))
        self.units = tokens.WordCache(lambda new: [array("i", x[self.lead :]).tobytes() for x in self.lib.encode(["\n" + u for u in new], num_threads=1)])

    def _step(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the next user symbol, known prefix or character, and what stands for it."""
        own = next((u for u in self.user if text.startswith(u, at)), None)
        hit = (len(own), own) if own else self.map.longest(text, at)
        if hit is None:
            width = 1 if text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
            hit = (width, text[at : at + width])
        return hit

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, its source byte offset."""
        out, source, at = bytearray(), [], 0
        n = len(text)
        if self.squeeze:
            while at < n and (first := self._step(text, at))[1] == b" ":
                at += first[0]
        if n and at < n and self.dummy:
            out += SPACE if self.escape else b" "
            source += [at] * (len(SPACE) if self.escape else 1)
        space = self.squeeze
        while at < n:
            size, new = self._step(text, at)
            if self.squeeze:
                while space and new.startswith(b" "):
                    new = new[1:]
            if new:
                space = self.squeeze and new.endswith(b" ")
                new = new.replace(b" ", SPACE) if self.escape else new
                out += new
                source += [at] * len(new)
            at += size
        mark = SPACE if self.escape else b" "
        while self.squeeze and out.endswith(mark):
            del out[-len(mark) :]
            at = source[-len(mark)]
            del source[-len(mark) :]
        return bytes(out), np.array([*source, at], dtype=np.int64)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte interval of each id; ids that cover no text have empty ones."""
        _, source = self.normalise(text)
        end = np.cumsum(self.size[ids])
        return source[end - self.size[ids]], source[end]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids of all texts without end ids, and where each text's begin."""
        data, offsets = buffers(texts)
        if not self.splits:
            return self._whole(texts.to_pylist())
        size = np.diff(offsets)
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, "▁|\\x00")))
        # a space before each text that has bytes stands for the dummy prefix
        first = offsets[:-1][size > 0]
        padded = np.insert(data, first, 32)
        begin = offsets[:-1] + np.concatenate([[0], np.cumsum(size > 0)])[:-1]
        bounds = np.append(begin, len(padded))
        is_space = padded == 32
        alone = self.solitary[padded]
        cut = np.zeros(len(padded) + 1, dtype=bool)
        cut[bounds] = True
        cut[:-1] |= alone
        cut[1:] |= alone
        cut[1:-1] |= is_space[1:] & ~is_space[:-1]
        edge = np.flatnonzero(cut)
        starts, ends = edge[:-1], edge[1:]
        ids, before = self.units.encode_pieces(padded, starts, ends)
        cuts = before[np.searchsorted(starts, bounds)] if len(starts) else np.zeros(len(bounds), np.int64)
        if len(odd):
            whole, own = self._whole(texts.take(pa.array(odd)).to_pylist())
            parts = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            for k, i in enumerate(odd):
                parts[i] = whole[own[k] : own[k + 1]]
            ids = np.concatenate(parts)
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, cuts

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.lib.encode(texts, num_threads=1)
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return np.array([i for x in found for i in x], dtype=np.int32), cuts

    def all_spans(self, texts: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """spans() of all texts at once; without a character map only spaces change size, so sums suffice."""
        data, offsets = buffers(texts)
        low, high = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        plain = self.splits and not pc.any(pc.match_substring(texts, "▁")).as_py()
        if not plain:
            for i in range(len(texts)):
                a, b = cuts[i], cuts[i + 1]
                low[a:b], high[a:b] = self.spans(data[offsets[i] : offsets[i + 1]].tobytes(), ids[a:b])
            return low, high
        own = self.source_size[ids]
        first = cuts[:-1][np.diff(cuts) > 0]
        own[first] -= 1
        total = np.cumsum(own)
        begin = np.concatenate([[0], total])[cuts[:-1]]
        shift = np.repeat(begin, np.diff(cuts))
        high = total - shift
        return high - own, high

    @property
    def source_size(self) -> np.ndarray:
        """Bytes of plain source that each id covers, a space mark being one byte."""
        if not hasattr(self, "_source_size"):
            marks = np.array([self.lib.id_to_piece(i).count("▁") for i in range(len(self.size))])
            self._source_size = self.size - 2 * marks * (self.size > 1)
        return self._source_size


def model(path: str) -> Model:
    return tokens.held(Model, path)


FIELDS = StructType([
    StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())),
    StructField("begin", ArrayType(IntegerType())), StructField("end", ArrayType(IntegerType())), StructField("decoded", StringType()),
])
DIGESTS = StructType([
    StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("spans_sha256", StringType()),
    StructField("decoded", StringType()), StructField("covered", LongType()),
])


def _encoded(path: str, text: str, digests: bool):
    decimal: dict[int, bytes] = {}

    def compute(batch: pa.RecordBatch) -> list:
        m = model(path)
        texts = strings(batch.column(text))
        ids, cuts = m.encode(texts)
        low, high = m.all_spans(texts, ids, cuts)
        out: list[list] = [[] for _ in (DIGESTS if digests else FIELDS)]
        if digests and not decimal:
            decimal.update((i, b"%d" % i) for i in range(len(m.size)))
        for i in range(len(texts)):
            a, b = cuts[i], cuts[i + 1]
            own = [*ids[a:b].tolist(), m.end]
            last = int(high[b - 1]) if b > a else 0
            decoded = m.lib.decode(own)
            if digests:
                row = (len(own), hashlib.sha256(b" ".join([decimal[x] for x in own])).hexdigest(), hashlib.sha256(high[a:b].astype("<u4").tobytes()).hexdigest(), decoded, last)
            else:
                row = (len(own), own, np.append(low[a:b], last).astype(np.int32), np.append(high[a:b], last).astype(np.int32), decoded)
            for column, x in zip(out, row):
                column.append(x)
        return out

    return compute


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text", out: str = "pieces", carry: list[str] | None = None, digests: bool = False) -> DataFrame:
    """The carried columns of docs and a struct `out`: n_tokens and ids (end id included), begin and end of each
    piece's source bytes, and the decoded text. With `digests` ids and span ends come as SHA-256 (decimal ids
    joined by a space; ends as little-endian 32-bit numbers) beside the bytes covered, to keep rows small.
    """
    return add_struct(docs, out, DIGESTS if digests else FIELDS, _encoded(model_path or tokens.default("piece_bpe_32k.model"), text_col, digests), text=text_col, carry=carry)


