"""Byte-level BPE over a block of texts: encode each distinct word once, put the ids back by position.

A text is cut before every single space that follows a character other than white space. The
pre-tokenizer of byte-level BPE always breaks there, so a text's ids are its words' ids in order
and a word's ids never depend on its neighbours. Empty and null texts have no ids.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space characters, as regular expression classes hold them.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WHITE_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Words of these characters, one leading space aside, are encoded together; the others one by one.
_PLAIN = r"^ [!-~\x{a1}-\x{24f}](?:[!-~\x{a1}-\x{24f}\n]*[!-~\x{a1}-\x{24f}])?$"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character; this undoes it."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE file of the tokenizers library, with vectorised encoding and decoding of blocks."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        chars = _byte_of_char()
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            pieces[i] = special[i].encode() if i in special else bytes(chars[c] for c in token)
        self.size = len(pieces)
        #: The id-to-piece table: bytes of each id, and its decimal digits with a comma.
        self.pieces = pa.array(pieces, pa.large_binary())
        self.digits = pa.array([f"{i},".encode() for i in range(self.size)], pa.large_binary())
        self.specials = [s for s in special.values() if s]
        self._spaced = np.array([p[:1] == b" " for p in pieces])
        self._many = self._joined_encoder(path, {p: i for i, p in enumerate(pieces) if p and i not in special})

    def _joined_encoder(self, path: str, ranks: dict[bytes, int]):
        """An encoder of long strings for the same merges, if ids follow the merges' order as it requires."""
        try:
            import tiktoken
        except ImportError:
            return None
        model = json.load(open(path, encoding="utf-8"))["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        ids = [vocab["".join(m)] for m in merges]
        if sorted(ids) != ids or len(set(ranks)) != len(ids) + 256 or min(ids) < 256:
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode_words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one after another, and their offsets by word."""
        n = len(words)
        counts = np.zeros(n, np.int64)
        plain = np.zeros(n, bool)
        if self._many is not None and n:
            plain = np.asarray(pc.match_substring_regex(words, _PLAIN))
            for text in self.specials:
                plain = plain & ~np.asarray(pc.match_substring(words, text))
        together = words.filter(pa.array(plain))
        if len(together):
            _, ends, data = together.buffers()
            ends = np.frombuffer(ends, np.int64, len(together) + 1, 8 * together.offset)
            text = str(memoryview(data)[ends[0] : ends[-1]], "utf-8")
            joined = np.asarray(self._many.encode_to_numpy(text, disallowed_special=()), np.uint32)
            starts = np.flatnonzero(self._spaced[joined])
            counts[plain] = np.diff(np.append(starts, len(joined)))
        else:
            joined = np.empty(0, np.uint32)
        rest = words.filter(pa.array(~plain)).to_pylist()
        single = [e.ids for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)] if rest else []
        counts[~plain] = [len(x) for x in single]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(offsets[-1], np.uint32)
        of_plain = np.repeat(plain, counts)
        ids[of_plain] = joined
        if single:
            ids[~of_plain] = np.fromiter((i for x in single for i in x), np.uint32)
        return ids, offsets

    def decoded(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids' pieces, one after another, and the byte offset of each id."""
        return taken(self.pieces, ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per Python worker and file."""
    return Codec(path)


def words_of(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """Distinct words of a block, the word at every position, and the first position of every text (and the end)."""
    if not len(texts):
        return pa.array([], pa.large_string()), np.empty(0, np.int64), np.zeros(1, np.int64)
    odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _WHITE_SPACE)))
    if len(odd):
        even = np.ones(len(texts), bool)
        even[odd] = False
        split = pc.split_pattern(pc.if_else(pa.array(even), texts, pa.scalar("", pa.large_string())), " ")
    else:
        split = pc.split_pattern(texts, " ")
    first = np.asarray(split.offsets, np.int64)
    first = first - first[0]
    coded = split.flatten().dictionary_encode()
    codes = np.asarray(coded.indices, np.int64)
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string())) if len(coded.dictionary) else coded.dictionary
    own = split.flatten().take(pa.array(first[:-1])).dictionary_encode()
    codes[first[:-1]] = len(spaced) + np.asarray(own.indices, np.int64)
    words = [spaced.cast(pa.large_string()), own.dictionary.cast(pa.large_string())]
    if len(odd):
        base = len(spaced) + len(own.dictionary)
        cut = [_CHUNK.findall(t) for t in texts.take(pa.array(odd)).to_pylist()]
        more = pa.array([w for c in cut for w in c], pa.large_string()).dictionary_encode()
        words.append(more.dictionary)
        lengths = np.diff(first)
        lengths[odd] = [len(c) for c in cut]
        whole = np.concatenate([[0], np.cumsum(lengths)])
        mine = np.repeat(np.isin(np.arange(len(texts)), odd), lengths)
        out = np.empty(whole[-1], np.int64)
        out[mine] = base + np.asarray(more.indices, np.int64)
        out[~mine] = codes[np.repeat(~np.isin(np.arange(len(texts)), odd), np.diff(first))]
        codes, first = out, whole
    words = pa.concat_arrays(words)
    seen = np.bincount(codes, minlength=len(words)) > 0
    return words.filter(pa.array(seen)), (np.cumsum(seen) - 1)[codes], first


def at_positions(ids: np.ndarray, offsets: np.ndarray, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts from the ids of words: every position takes its word's ids; and the texts' offsets."""
    counts = np.diff(offsets)[codes]
    ends = np.cumsum(counts)
    begins = np.concatenate([[0], ends])
    index = np.repeat(offsets[:-1][codes] - begins[:-1], counts)
    index += np.arange(len(index))
    return ids[index], begins[first]


def encode_block(codec: Codec, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block of texts, one after another, and their offsets by text."""
    words, codes, first = words_of(texts)
    return at_positions(*codec.encode_words(words), codes, first)


def taken(table: pa.LargeBinaryArray, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of a binary table for each id as one run of bytes, and each id's offset in it."""
    if not len(ids):
        return memoryview(b""), np.zeros(1, np.int64)
    found = table.take(pa.array(ids))
    return memoryview(found.buffers()[2]), np.frombuffer(found.buffers()[1], np.int64, len(ids) + 1)


def crcs(ids: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Unsigned CRC-32 of each run of ids as little-endian unsigned 32-bit integers."""
    data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B") if len(ids) else memoryview(b"")
    return [crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def bucket_of(words: pa.LargeStringArray, buckets: int) -> np.ndarray:
    return np.fromiter(map(crc32, map(str.encode, words.to_pylist(), repeat("utf-8"))), np.int64, len(words)) % buckets
