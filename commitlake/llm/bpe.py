"""Byte-level BPE as a lazily determinised finite-state transducer.

Two tokens may stand next to each other in an encoding exactly if BPE of their joined bytes gives these two tokens
back, and a sequence of tokens is the encoding of its bytes exactly if that holds for all its neighbours. So every
prefix of a word has one last token, which follows from the last tokens of shorter prefixes: BPE reads left to right.

``Transducer`` turns this into an automaton. Its state is the last token that is certain and the bytes after it;
reading a byte gives the next state and the tokens that have become certain, namely those that all prefixes at which
a longer token can still start have in common. No token is longer than ``max_token`` bytes, so output lags behind
input by a bounded lookahead. States and transitions are made when first met and kept (up to ``max_states``).

Words (the pieces of the pre-tokeniser's pattern) are encoded once and kept in a table of bounded size.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokeniser pattern of the 50k byte-level vocabularies (fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces, found faster: the alternatives exclude each other by their first characters, so their order is
#: free, and a run of one class never gives back; for texts in ASCII its classes are spelt out.
_FAST = r" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
_ASCII = r" ?[A-Za-z]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^ \t\n\r\f\vA-Za-z0-9]++|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary is sent to the executors only up to this size.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a line each of the token in base64 and its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[int]:
    """BPE by its definition: join the neighbours of lowest rank, leftmost first, until none of rank ``below`` can be."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encoder of single words over ``ranks``, which must hold all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.max_token = max(map(len, ranks))
        self.max_states = max_states
        self._inner = {token[:k] for token in ranks for k in range(1, len(token))}  # what a longer token starts with
        self._fits: dict[tuple[int, int], bool] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: certain token (-1: none), bytes after it, last token at each of their prefixes, live starts
        self._states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...]]] = [(-1, b"", (-1,), (0,))]
        self._number: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self._next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._final: dict[int, tuple[int, ...]] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        found = self._parts.get(token, ())
        if found == ():
            whole = self.tokens[token]
            parts = merge_by_rank(whole, self.ranks, token) if len(whole) > 1 else []
            found = self._parts[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; -1 is the start of the word.

        Merging goes up in rank. Seen backwards, the token of higher rank at the boundary is taken apart first, and
        the two tokens that then touch must not be joinable before it was made; of equal ranks the left one comes first.
        """
        if left < 0:
            return self._whole(right)
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            found = self._fits[key] = self._whole(right) and self._touch(left, right)
        return found

    def _whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as it."""
        return len(self.tokens[token]) == 1 or self._halves(token) is not None

    def _touch(self, left: int, right: int) -> bool:
        ranks, tokens = self.ranks, self.tokens
        made = 1 << 60
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < made:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                made, left = left, a[1]
            else:
                made, right = right + 1, b[0]

    def _chain(self, last: tuple[int, ...] | list[int], at: int) -> list[int]:
        """Boundaries from 0 to ``at`` of the encoding that ends there."""
        chain = [at]
        while at:
            at -= len(self.tokens[last[at]])
            chain.append(at)
        return chain[::-1]

    def _advance(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        _, held, last, live = self._states[number]
        held += bytes((byte,))
        end = len(held)
        tails = [held[j:] for j in live]
        token = next(t for j, tail in zip(live, tails, strict=True) if (t := self.ranks.get(tail)) is not None and self._compatible(last[j], t))
        ends = (*last, token)
        starts = [j for j, tail in zip(live, tails, strict=True) if tail in self._inner]
        starts.append(end)
        shared = starts[0]
        if len(starts) > 1:
            open_ends = set(starts)
            while len(open_ends) > 1:  # the last boundary steps back to the one before it until all have met
                furthest = max(open_ends)
                open_ends.remove(furthest)
                open_ends.add(furthest - len(self.tokens[ends[furthest]]))
            shared = open_ends.pop()
        out = tuple(ends[b] for b in self._chain(ends, shared)[1:]) if shared else ()
        key = (ends[shared], held[shared:])
        known = self._number.get(key)
        if known is None:
            known = self._number[key] = len(self._states)
            self._states.append((key[0], key[1], ends[shared:], tuple(j - shared for j in starts)))
        self._next[number << 8 | byte] = (known, out)
        return known, out

    def _finish(self, number: int) -> tuple[int, ...]:
        _, held, last, _ = self._states[number]
        out = self._final[number] = tuple(last[b] for b in self._chain(last, len(held))[1:])
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        if len(self._states) > self.max_states:
            self._reset()
        state, out, table = 0, [], self._next
        for byte in word:
            state, more = table.get(state << 8 | byte) or self._advance(state, byte)
            if more:
                out.extend(more)
        out.extend(self._final.get(state) or self._finish(state))
        return out


class Utf8Stream:
    """Bytes to text in pieces: a state machine that holds back the bytes of a character not yet complete.

    Bytes that belong to no character become U+FFFD, one for each longest part of a possible character.
    """

    def __init__(self) -> None:
        self._held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """Number of bytes at the end of ``data`` that may be the start of a character."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            length = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if length <= back:
                return 0
            if back > 1:  # the second byte has a narrower range after some first bytes
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        """Text of the characters complete by now."""
        data = self._held + data
        keep = self._open(data)
        self._held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        """Text of what is left at the end."""
        data, self._held = self._held, b""
        return data.decode("utf-8", "replace")


class Tokenizer:
    """Text to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, max_words: int = 500_000) -> None:
        self.transducer = Transducer(ranks)
        self._split = regex.compile(_FAST if pattern == PATTERN else pattern).findall
        self._split_ascii = re.compile(_ASCII).findall if pattern == PATTERN else self._split
        self._words: dict[str, bytes] = {}
        self.max_words = max_words

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of the whole text as 32-bit numbers in the machine's order."""
        if not text:
            return b""
        words = self._split_ascii(text) if text.isascii() else self._split(text)
        known = self._words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self.max_words:
                known.clear()
            for word in set(words).difference(known):
                known[word] = array("i", self.transducer.encode_word(word.encode("utf-8"))).tobytes()
            return b"".join(map(known.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; the empty list for an empty text and for None. Special tokens are ordinary text."""
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode(self, ids: Iterable[int] | None, piece: int = 4096) -> str:
        """Text of ``ids``, decoded ``piece`` tokens at a time."""
        stream, out, held, tokens = Utf8Stream(), [], [], self.transducer.tokens
        for token in ids or ():
            held.append(tokens[token])
            if len(held) == piece:
                out.append(stream.feed(b"".join(held)))
                held = []
        return "".join([*out, stream.feed(b"".join(held)), stream.close()])


_made: dict[int, Tokenizer] = {}


def tokenizer(data: bytes) -> Tokenizer:
    """The tokenizer of a rank file's content, made once in each process."""
    key = hash(data)
    if key not in _made:
        _made[key] = Tokenizer(read_ranks(data))
    return _made[key]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file as a broadcast, so that executors need no copy of their own."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def encode(df: DataFrame, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY, ids: str | None = "ids", count: str | None = None) -> DataFrame:
    """``keep`` columns with ``ids`` (array<int>) and, if named, ``count`` (bigint) of every row's text; no shuffle.

    Empty and NULL texts give an empty list and count 0. Texts are encoded whole, of whatever length. Repeated rows
    and ties are encoded each; an empty table gives an empty result.
    """
    held = _vocabulary(df, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(held.value)
        for batch in batches:
            for start in range(0, max(len(batch), 1), 256):  # lists of ids are larger than the texts: small pieces
                part = batch.slice(start, 256)
                packed = [coder.encode_packed(t) for t in part.column(len(keep)).to_pylist()]
                sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                columns = list(part.columns[: len(keep)])
                if ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))))
                if count:
                    columns.append(pa.array(sizes))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [*keep, *([ids] if ids else []), *([count] if count else [])]
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = kept + (f", `{ids}` array<int>" if ids else "") + (f", `{count}` bigint" if count else "")
    return df.select(*keep, F.col(text).cast("string").alias("b_text")).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """``keep`` columns with ``text`` decoded from the array ``ids``; NULL and empty arrays give an empty text."""
    held = _vocabulary(df, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(held.value)
        for batch in batches:
            texts = pa.array([coder.decode(x) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*keep, text])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(ids).alias("b_ids")).mapInArrow(run, f"{kept}, `{text}` string")

