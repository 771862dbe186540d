"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a partition's texts are laid out one after another as symbols, those of one
chunk of text at a time; pieces that an earlier chunk of the partition had keep their ids.  An index
maps every adjacent pair to all the positions where it stands; a heap holds the ranks of the pairs
that occur.  The lowest rank is taken, all its positions are merged at once, and the lists of the
neighbouring pairs are updated.  A merge never creates a pair of a lower rank than its own, because
a symbol is made by one merge and used by later ones, so taking ranks in ascending order over all
pieces together gives each piece what it would get alone.

Defined results: a null text is encoded as an empty one, an empty text has no tokens and decodes to
an empty text, and every other column passes through unchanged.  An output column replaces an input
column of its name.  Texts are taken whole; a piece of any length costs n log n.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the public tokenizer: the splitting pattern of byte-level BPE, with \s written out
#: as the white space that Unicode defines (Python's own \s has four control characters more).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of text that are cut into pieces before the index over them is built.
CHUNK_CHARS = 8 << 20
#: Distinct pieces of a partition whose ids are kept; beyond, they are found anew.
KEPT_PIECES = 1 << 18


def _pattern(letter: str, number: str, space: str) -> str:
    """The splitting pattern over the members of three character classes."""
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+"
        rf"| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


PIECES = regex.compile(_pattern(r"\p{L}", r"\p{N}", SPACE))


def _latin_pieces() -> re.Pattern:
    """The same for texts of Latin-1 characters, with their classes written out, which is faster."""
    members = [re.escape("".join(c for c in map(chr, range(256)) if regex.fullmatch(rf"[{k}]", c))) for k in (r"\p{L}", r"\p{N}", SPACE)]
    return re.compile(_pattern(*members))


LATIN_PIECES = _latin_pieces()


def split(text: str) -> list[str]:
    """The pieces of a text, which merges never cross."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return PIECES.findall(text)
    return LATIN_PIECES.findall(text)


def byte_letters() -> list[str]:
    """Fixed value of byte-level vocabularies: the printable character that stands for each byte value."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = [""] * 256
    for b in shown:
        letters[b] = chr(b)
    for k, b in enumerate(hidden):
        letters[b] = chr(256 + k)
    return letters


class Vocabulary:
    """Ids of single bytes, merges in order of rank (left, right, merged), bytes by id, added tokens."""

    def __init__(self, byte_ids: list[int], merges: np.ndarray, id_bytes: list[bytes], added: dict[str, int]):
        self.byte_ids, self.merges, self.id_bytes, self.added = byte_ids, merges, id_bytes, added
        self.left, self.right, self.merged = merges.T.tolist()
        keys = (merges[:, 0].astype(np.int64) << 32) | merges[:, 1]
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.letters = np.array(byte_ids, np.int32)
        longest_first = sorted(added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first))) if added else None

    def __reduce__(self):
        return Vocabulary, (self.byte_ids, self.merges, self.id_bytes, self.added)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it isn't merged."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[k] == key) & (left >= 0) & (right >= 0), self.by_key[k], -1)

    def lay_out(self, pieces: list[bytes | int]) -> np.ndarray:
        """The symbols of all pieces, with -1 around each."""
        raw = [b"\0" if isinstance(p, int) else p for p in pieces]
        sizes = np.array([len(p) for p in raw], np.int64)
        symbol = np.full(int(sizes.sum()) + len(raw) + 1, -1, np.int32)
        piece = np.repeat(np.arange(len(raw)), sizes)
        symbol[np.arange(len(piece)) + piece + 1] = self.letters[np.frombuffer(b"".join(raw), np.uint8)]
        starts = np.cumsum(sizes + 1) - sizes
        for k, p in enumerate(pieces):
            if isinstance(p, int):
                symbol[starts[k]] = p
        return symbol


def read_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library (a fixed, small file) on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    letters = byte_letters()
    byte_of = {letter: b for b, letter in enumerate(letters)}
    pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    id_bytes = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for token, k in vocab.items():
        id_bytes[k] = bytes(byte_of[c] for c in token)
    for token, k in added.items():
        id_bytes[k] = token.encode()
    return Vocabulary([vocab[c] for c in letters], merges, id_bytes, added)


class _Numbering(dict):
    """Numbers distinct pieces in the order in which they are first asked for."""

    def __missing__(self, piece):
        number = self[piece] = len(self)
        return number


def merge_all(pieces: list[bytes | int], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and where each piece's ids begin; an added token stands as its id.

    Symbols lie in one array with -1 before, between and after the pieces; -2 is a symbol that was
    merged into the one before it.
    """
    symbol = vocabulary.lay_out(pieces)
    size = len(symbol)
    after = np.arange(1, size + 1, dtype=np.int32)
    before = np.arange(-1, size - 1, dtype=np.int32)
    at: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def note(positions: np.ndarray) -> None:
        """Enter positions in the index, under the rank of the pair that stands there."""
        rank = vocabulary.rank(symbol[positions], symbol[after[positions]])
        positions, rank = positions[rank >= 0], rank[rank >= 0]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        positions, rank = positions[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, found in zip(rank[np.r_[0, cuts]].tolist(), np.split(positions, cuts) if len(cuts) else [positions], strict=True):
            if r not in at:
                at[r] = []
                heapq.heappush(waiting, r)
            at[r].append(found)

    note(np.arange(size - 1, dtype=np.int32))
    while waiting:
        r = heapq.heappop(waiting)
        lists = at.pop(r)
        left, right, merged = vocabulary.left[r], vocabulary.right[r], vocabulary.merged[r]
        found = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        # a position is void if one of the two has been merged with its other neighbour meanwhile
        found = found[(symbol[found] == left) & (symbol[after[found]] == right)]
        if left == right:
            found = _every_other(found, after)
        if not len(found):
            continue
        gone = after[found]
        far = after[gone]
        symbol[found], symbol[gone] = merged, -2
        after[found], before[far] = far, found
        prev = before[found]
        # where the piece before was merged too, its own entry covers the pair between them
        note(np.concatenate([found, prev[symbol[prev] != merged]]))
    ends = np.flatnonzero(symbol == -1)
    kept = symbol >= 0
    starts = np.concatenate([[0], np.cumsum(kept)])[ends]
    return symbol[kept].astype("<u4"), starts


def _every_other(found: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of positions of one symbol twice, those that merge when runs are taken from the left."""
    taken, free = [], -1
    for k in found.tolist():
        if k != free:
            taken.append(k)
            free = int(after[k])
    return np.array(taken, dtype=found.dtype)


def _segments(text: str, vocabulary: Vocabulary):
    """Stretches of plain text, and the ids of added tokens between them."""
    start = 0
    for m in vocabulary.cut.finditer(text) if vocabulary.cut else ():
        yield text[start : m.start()], vocabulary.added[m[0]]
        start = m.end()
    yield text[start:], None


class PieceIds:
    """Ids of the distinct pieces that a partition has shown so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.number = _Numbering()
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Merge the pieces that were numbered since the last time."""
        fresh = list(self.number)[len(self.starts) - 1 :]
        ids, starts = merge_all([p.encode() if isinstance(p, str) else p for p in fresh], self.vocabulary)
        self.starts = np.concatenate([self.starts, starts[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def _chunk(self, texts: list[str]) -> list[bytes]:
        number, numbered = self.number, []
        for text in texts:
            row = []
            for segment, added in _segments(text, self.vocabulary):
                row += map(number.__getitem__, split(segment))
                if added is not None:
                    row.append(number[added])
            numbered.append(np.array(row, np.int64))
        self._learn()
        lengths, out = np.diff(self.starts), []
        for row in numbered:
            n = lengths[row]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(row) else 0
            out.append(self.ids[np.repeat(self.starts[row] - ends + n, n) + np.arange(total)].tobytes())
        if len(number) > KEPT_PIECES:
            self.forget()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of every text."""
        out: list[bytes] = []
        chunk, chars = [], 0
        for text in texts:
            text = text or ""
            if chunk and chars + len(text) > CHUNK_CHARS:
                out += self._chunk(chunk)
                chunk, chars = [], 0
            chunk.append(text)
            chars += len(text)
        return out + self._chunk(chunk)


def encode_texts(texts: list[str | None], vocabulary: Vocabulary) -> list[bytes]:
    return PieceIds(vocabulary).encode(texts)


def decode_ids(packed: bytes, vocabulary: Vocabulary) -> str:
    table = vocabulary.id_bytes
    ids = np.frombuffer(packed, "<u4").tolist()
    return b"".join([table[k] for k in ids]).decode("utf-8", errors="replace")


def share(spark: SparkSession, vocabulary: Vocabulary):
    """Broadcast a vocabulary: its size is that of a fixed file."""
    return spark.sparkContext.broadcast(vocabulary)


def encode(df: DataFrame, shared, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Add ``ids`` (packed little-endian unsigned 32-bit) and their number."""

    known: list[PieceIds] = []  # each task gets an empty list of its own, as the function is read anew

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        if not known:
            known.append(PieceIds(shared.value))
        return pd.Series(known[0].encode(list(texts)), dtype=object)

    return df.withColumn(ids, packed(F.col(text))).withColumn(n_tokens, (F.octet_length(ids) / 4).cast("long"))


def decode(df: DataFrame, shared, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that packed ids stand for; null ids decode to an empty text."""

    @F.pandas_udf("string")
    def unpacked(values: pd.Series) -> pd.Series:
        return pd.Series([decode_ids(v or b"", shared.value) for v in values], dtype=object)

    return df.withColumn(text, unpacked(F.col(ids)))
