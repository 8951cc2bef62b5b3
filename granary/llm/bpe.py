"""Byte-level BPE by prefix dynamic programming, and its inverse.

For every byte prefix of a piece exactly one token can come last, because the encoding of a prefix that ends between
two tokens is the encoding of the whole up to there, and a sequence of tokens is the encoding of its bytes just when
each adjacent pair is the encoding of its own. So `PrefixTable` keeps one token per prefix: it looks for the only token
that ends there and may follow the last token of what is before it. Appending bytes adds entries and changes none;
an edit keeps the entries before it. `EditableText` does the same for a whole text: it splits anew only near the edit.
Pieces new to a worker are taken in the order of their bytes, so one table goes from each to the next and keeps the
entries of the prefix that they share; workers keep what they know of pieces between tasks.

Ranks are as in the rank files of public tokenizers: the rank is the id, two neighbours merge if their bytes together
have a rank, the lowest rank first, then the leftmost; a piece that is itself a token is that token.
Texts are split by a pattern before; a null text is empty and has no tokens. Repeated rows each get a result, and an
empty table gives none. Texts are encoded whole, whatever their length; one longer than a megabyte is held alone. A kept
column of the name of an output (ids, n_tokens and the digests) or of text is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import chunks, map_batches

#: Of pieces, whose ids a worker remembers, and of pairs of tokens, whose verdict it does: how many at most before the
#: older half is forgotten; of chunks of text half as many. They only save time.
REMEMBERED = 300_000
#: The longest chunk or piece, in characters, that is remembered.
SHORT = 64
#: Tokens up to so many bytes are found by the last bytes of a prefix.
WINDOW = 4

#: Fixed value: the pattern by whose pieces no run of other characters goes on into white space. Texts are split into
#: chunks for it; for another pattern a text is one chunk.
BY_WHITE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The characters of Unicode's White_Space.
_WHITE = "\t-\r \x85\xa0  -     　"


class Memory(dict):
    """Remembers the last so many entries or more, and at most twice as many."""

    def __init__(self, most: int = REMEMBERED):
        super().__init__()
        self.most = most
        self.older: dict = {}

    def recall(self, key):
        """What is known of key, else None; get() sees only what was put or recalled of late."""
        value = self.older.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


class Vocabulary:
    """The ranks of a file of lines `base64 rank`."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest_after: dict[bytes, int] = {}  # by last WINDOW bytes: of longer tokens that end so, the length of the longest
        for token in ranks:
            if len(token) > WINDOW:
                self.longest_after[token[-WINDOW:]] = max(len(token), self.longest_after.get(token[-WINDOW:], 0))
        self.tails = Memory()
        self.pairs = Memory()
        self._alone: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by merging, for short byte strings: what the pair tests rest on."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank_of, never = self.ranks.get, sys.maxsize
        ranks = [rank_of(piece[i : i + 2], never) for i in range(len(piece) - 1)]
        while ranks and (least := min(ranks)) != never:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], never)
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], never)
        return [self.ranks[p] for p in parts]

    def may_start(self, token: int) -> bool:
        if (known := self._alone.get(token)) is None:
            known = self._alone[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None and (known := self.pairs.recall(key)) is None:
            both = self.bytes_of[before] + self.bytes_of[token]
            known = both not in self.ranks and self.merge(both) == [before, token]
            self.pairs.put(key, known)
        return known

    def tail(self, last: bytes) -> tuple[int, tuple[tuple[int, int], ...]]:
        """Of bytes that end in these (WINDOW, or all there are): the most bytes of a longer token that may end there, 0
        for none, and the tokens that do, with their lengths, longest first."""
        known = self.tails.recall(last)
        if known is None:
            inside = tuple((len(last) - k, token) for k in range(len(last)) if (token := self.ranks.get(last[k:])) is not None)
            known = self.longest_after.get(last, 0), inside
            self.tails.put(last, known)
        return known

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class PrefixTable:
    """The last token of each byte prefix of a piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Adds bytes; the entries of earlier prefixes stay."""
        v, last = self.vocabulary, self.last
        token_of, known_tail, known_pair, may_follow = v.ranks.get, v.tails.get, v.pairs.get, v.may_follow
        done, piece = len(self.piece), self.piece + more
        self.piece = piece
        for end in range(done + 1, len(piece) + 1):
            window = piece[end - WINDOW if end > WINDOW else 0 : end]
            reach, ending = known_tail(window) or v.tail(window)
            if reach and end > WINDOW:
                ending = (*((end - k, token) for k in range(max(end - reach, 0), end - WINDOW) if (token := token_of(piece[k:end])) is not None), *ending)
            for length, token in ending:
                begin = end - length
                if not begin:
                    fits = v.may_start(token)
                elif (fits := known_pair(last[begin - 1] << 32 | token)) is None:
                    fits = may_follow(last[begin - 1], token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def become(self, piece: bytes) -> None:
        """Makes it the table of another piece; the entries of the prefix that both share stay."""
        same, limit = 0, min(len(self.piece), len(piece))
        while same < limit and self.piece[same] == piece[same]:
            same += 1
        self.cut(same)
        self.append(piece[same:])

    def cut(self, size: int) -> None:
        """Keeps the first size bytes."""
        self.piece, self.last = self.piece[:size], self.last[:size]

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.piece)
        if whole is not None:
            return [whole]
        found, end = [], len(self.piece)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[found[-1]])
        return found[::-1]


class Encoder:
    """Encodes texts; remembers the ids of chunks, each a run of white space and what follows it up to the next."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern).findall
        self.chunks = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+").findall if pattern == BY_WHITE else lambda text: [text]
        self.known_chunks, self.known_pieces = Memory(REMEMBERED // 2), Memory()

    def _learn(self, pieces: set[str]) -> None:
        """Remembers the short ones, each table made of the one before."""
        recall, put, rank_of = self.known_pieces.recall, self.known_pieces.put, self.vocabulary.ranks.get
        table = PrefixTable(self.vocabulary)
        for data, piece in sorted((p.encode(), p) for p in pieces if len(p) <= SHORT and p not in self.known_pieces and recall(p) is None):
            whole = rank_of(data)
            if whole is None:
                table.become(data)
                ids = table.ids()
            put(piece, struct.pack("<I", whole) if whole is not None else struct.pack(f"<{len(ids)}I", *ids))

    def _piece(self, piece: str) -> bytes:
        known = self.known_pieces.recall(piece)
        if known is None:
            ids = PrefixTable(self.vocabulary, piece.encode()).ids()
            known = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def _chunk(self, chunk: str, pieces: list[str]) -> bytes:
        known, piece = self.known_pieces.get, self._piece
        data = b"".join([known(p) or piece(p) for p in pieces])
        if len(chunk) <= SHORT:
            self.known_chunks.put(chunk, data)
        return data

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers."""
        found = [self.chunks(text) for text in texts]
        known, recall = self.known_chunks.get, self.known_chunks.recall
        new = {c: self.pieces(c) for c in {c for cs in found for c in cs if c not in self.known_chunks} if recall(c) is None}
        self._learn({p for pieces in new.values() for p in pieces})
        made = {c: self._chunk(c, pieces) for c, pieces in new.items()}
        forgotten = lambda c: recall(c) or self._chunk(c, self.pieces(c))
        return [b"".join([known(c) or made.get(c) or forgotten(c) for c in cs]) for cs in found]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def load_encoder(path: str, pattern: str) -> Encoder:
    """The process's encoder: workers live on between tasks, and what it remembers is bounded."""
    return Encoder(load_vocabulary(path), pattern)


class EditableText:
    """A text with its pieces and their tables. Appends and edits give exactly what encoding the new text would."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.match, self.by_white = vocabulary, regex.compile(pattern).finditer, pattern == BY_WHITE
        self.text, self.starts, self.tables = "", [], []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    @staticmethod
    def _chunk_start(text: str, at: int) -> int:
        """The start of the last run of white space that begins before at and is followed by another run before it."""
        white = re.compile(f"[{_WHITE}]").match
        for inside in (True, False, True):  # white space that the edit touches, a run of others, white space before it
            while at and bool(white(text, at - 1)) == inside:
                at -= 1
        return at

    def replace(self, begin: int, end: int, new: str) -> int:
        """Puts new in place of text[begin:end]; returns how many pieces were split anew.

        A run of white space and one of other characters are each split without a look beyond the first character of
        the next, so splitting starts anew at the start of the run of white space before the run that the edit touches,
        and ends where a new piece begins, behind the edit, at the place of an old one. That holds for BY_WHITE; by
        another pattern all is split anew, and only the tables before the edit stay.
        """
        old, self.text = self.text, self.text[:begin] + new + self.text[end:]
        shift = len(self.text) - len(old)
        first = max(0, bisect_right(self.starts, self._chunk_start(old, begin)) - 1) if self.by_white else 0
        at = self.starts[first] if self.starts else 0
        later = {s + shift: k for k, s in enumerate(self.starts) if s >= end and k >= first} if self.by_white else {}
        starts, tables, rest, done = [], [], len(self.starts), 0
        for m in self.match(self.text, at):
            if m.start() in later and m.start() >= begin + len(new):
                rest = later[m.start()]
                break
            done += 1
            data, k = m[0].encode(), first + len(starts)
            table = None
            if k < len(self.starts) and self.starts[k] == m.start() < begin:  # it grew, shrank or stayed: its prefix holds
                table = self.tables[k]
                table.become(data)
            starts.append(m.start())
            tables.append(table or PrefixTable(self.vocabulary, data))
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[rest:]]
        self.tables = self.tables[:first] + tables + self.tables[rest:]
        return done

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in t.ids()]


def encode_texts(docs: DataFrame, vocabulary_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Per row: the kept columns, ids (binary, little-endian unsigned 32-bit, unless ids is False), n_tokens, ids_sha256
    and decoded_sha256, the digest of the bytes that the ids decode to.

    The vocabulary file must be readable at that path on every executor, as an installed package's file is.
    """
    if clash := {"text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"} & set(keep):
        raise ValueError(f"kept columns are named as outputs: {sorted(clash)}")
    picked = docs.select(*keep, "text")
    extra = [T.StructField("ids", T.BinaryType())] * ids + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([f for f in picked.schema.fields if f.name in keep] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(vocabulary_path)
        encoder = load_encoder(vocabulary_path, pattern)
        for whole in batches:
            for part in chunks(whole.column("text")):  # about a megabyte of text, so that few ids are held at a time
                batch = whole.slice(part.first, part.n)
                rows: list[list] = [[], [], [], []]
                for data in encoder.encode_all([text or "" for text in batch.column("text").to_pylist()]):
                    numbers = array("I", data)
                    if sys.byteorder == "big":
                        numbers.byteswap()
                    rows[0].append(data if ids else None)
                    rows[1].append(len(numbers))
                    rows[2].append(hashlib.sha256(data).hexdigest())
                    rows[3].append(hashlib.sha256(vocabulary.decode(numbers)).hexdigest())
                made = [pa.array(rows[0], pa.binary())] * ids + [pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [f.name for f in schema])

    return map_batches(picked, run, schema)
