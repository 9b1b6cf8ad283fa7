"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its encoding.
``PrefixEncoding`` stores that token for each prefix: the encoding of the whole
string is read off backwards, an append only extends the table, and an edit
recomputes the table from the edit on until it runs in step with the old one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tierflow.llm.batches import bounded, released, slices

#: Entries that a worker's cache of encoded chunks may hold before it is emptied.
CACHE_ENTRIES = 120_000
#: Longer chunks are not kept in the cache.
CACHE_CHUNK = 64
#: Characters of the texts whose new pre-tokens are encoded together.
GROUP_CHARS = 2_000_000
_NEVER = 1 << 60
_FIRST = "\ud800"  # no valid text holds it


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Vocabulary:
    """Tokens with what is needed to tell whether two of them may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks))
        # automaton over the bytes: a state is the longest end of the text that begins a token
        self._child: dict[int, int] = {}
        fallback, self._ends, steps = [0], [()], []
        for token, rank in ranks.items():
            state = 0
            for depth, byte in enumerate(token):
                step = state * 256 + byte
                state = self._child.get(step, 0)
                if not state:
                    state = self._child[step] = len(fallback)
                    fallback.append(0)
                    self._ends.append(())
                    steps.append((depth, step))
            self._ends[state] = ((len(token), rank),)
        self._fallback, self._steps = fallback, {}
        for depth, step in sorted(steps):  # shorter states first
            state = self._child[step]
            fallback[state] = self._step(fallback[step >> 8], step & 255) if depth else 0
            self._ends[state] += self._ends[fallback[state]]
        # what two neighbours merge into
        self._merged: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self._merged[left * self.size + right] = rank
        # each token's pieces at its left and right edge with the rank of the merge that ends them
        self._left: list[tuple] = [()] * self.size
        self._right: list[tuple] = [()] * self.size
        for token, rank in sorted(ranks.items(), key=lambda item: len(item[0])):
            first, last = self._halves(token, rank)
            self._left[rank] = ((rank, _NEVER),) if first is None else ((rank, _NEVER), (first, rank), *self._left[first][1:])
            self._right[rank] = ((rank, _NEVER),) if last is None else ((rank, _NEVER), (last, rank), *self._right[last][1:])
        self._fits: dict[int, bool] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int | None, int | None]:
        """The two tokens whose merge makes this one; (None, None) for a single byte."""
        if len(token) == 1:
            return None, None
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            merges = [self._merged.get(a * self.size + b, _NEVER) for a, b in zip(parts, parts[1:])]
            at = merges.index(min(merges))
            if merges[at] >= rank:
                break  # not reachable by merges: treated as a token that only a whole piece can be
            parts[at : at + 2] = [merges[at]]
        return parts[0], parts[-1]

    def fits(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``: no merge across their border comes before the merges inside them."""
        key = a * self.size + b
        known = self._fits.get(key)
        if known is None:
            known = self._fits_now(a, b)
            if len(self._fits) >= 2 * CACHE_ENTRIES:
                self._fits.clear()
            self._fits[key] = known
        return known

    def _fits_now(self, a: int, b: int) -> bool:
        for x, x_ends in self._right[a]:
            for y, y_ends in self._left[b]:
                merge = self._merged.get(x * self.size + y)
                # at the same rank the leftmost pair merges first
                if merge is not None and merge < x_ends and merge <= y_ends:
                    return False
        return True

    def _step(self, state: int, byte: int) -> int:
        """The automaton's next state, kept for the next time."""
        child, key = self._child, state * 256 + byte
        to = child.get(key)
        while to is None and state:
            state = self._fallback[state]
            to = child.get(state * 256 + byte)
        if len(self._steps) >= 2 * CACHE_ENTRIES:
            self._steps.clear()
        self._steps[key] = to = to or 0
        return to

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else PrefixEncoding(self, piece).tokens()

    def encode_sorted(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of sorted pre-tokens.

        Neighbours in sorted order begin alike, and what the table holds of their
        common prefix stays.
        """
        table, ids, out, pack = PrefixEncoding(self), [b""], [], struct.Struct("<I").pack
        bytes_of, ranks = self.bytes_of, self.ranks
        for piece in pieces:
            old, common = table.text, 0
            for x, y in zip(old, piece):
                if x != y:
                    break
                common += 1
            table.keep(common)
            del ids[common + 1 :]
            table.append(piece[common:])
            last = table.last
            for end in range(common + 1, len(piece) + 1):
                token = last[end]
                ids.append(ids[end - len(bytes_of[token])] + pack(token))
            whole = ranks.get(piece)
            out.append(ids[-1] if whole is None else pack(whole))
            if len(piece) > CACHE_CHUNK:  # prefixes of very long ones are not worth their memory
                table, ids = PrefixEncoding(self), [b""]
        return out


class PrefixEncoding:
    """The last token of every prefix of one pre-token; follows appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last, self._states = vocabulary, b"", [-1], [0]
        self.append(text)

    def keep(self, size: int) -> None:
        """Forget everything behind the first ``size`` bytes."""
        self.text = self.text[:size]
        del self.last[size + 1 :], self._states[size + 1 :]

    def append(self, more: bytes) -> None:
        """Add bytes at the end; the table of the old prefixes stays as it is."""
        vocabulary, last, states = self.vocabulary, self.last, self._states
        steps, ends, fitting, size = vocabulary._steps, vocabulary._ends, vocabulary._fits, vocabulary.size
        state, done = states[-1], len(self.text)
        for byte in more:
            done += 1
            to = steps.get(state * 256 + byte)
            state = vocabulary._step(state, byte) if to is None else to
            for length, token in ends[state]:  # longest first
                if length == done:
                    break
                before = last[done - length]
                fits = fitting.get(before * size + token)
                if vocabulary.fits(before, token) if fits is None else fits:
                    break
            last.append(token)
            states.append(state)
        self.text += more

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to stop; returns how many prefixes were recomputed.

        A prefix's last token depends on the last tokens of as many prefixes before
        it as the longest token has bytes. Once that many agree with the old table,
        the rest agrees as well and is copied.
        """
        last, states, rest = self.last, self._states, self.text[stop:]
        longest = self.vocabulary.longest
        old_last, old_states = last[stop:], states[stop:]
        self.keep(start)
        self.append(new)
        same = 0
        for at in range(len(rest)):
            self.append(rest[at : at + 1])
            same = same + 1 if self.last[-1] == old_last[at + 1] and self._states[-1] == old_states[at + 1] else 0
            if same >= longest:
                self.last += old_last[at + 2 :]
                self._states += old_states[at + 2 :]
                self.text += rest[at + 1 :]
                return len(new) + at + 1
        return len(new) + len(rest)

    def tokens(self) -> list[int]:
        """The encoding, read backwards from the table."""
        out, end, bytes_of = [], len(self.text), self.vocabulary.bytes_of
        while end:
            out.append(self.last[end])
            end -= len(bytes_of[self.last[end]])
        out.reverse()
        return out


class TextEncoder:
    """Whole texts: pre-tokens by the pattern, ids as little-endian unsigned 32-bit integers.

    A pre-token of the pattern never runs from visible characters into white space,
    so a text falls into chunks before each space that follows a visible character;
    chunks are encoded separately and frequent ones come from a bounded cache.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self._pieces = regex.compile(pattern).findall
        self._odd = regex.compile(r"\s |^ | $").search
        self._cut = regex.compile(r"(?<=\S)(?= )").split
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        """Chunks without their leading space, so a first chunk that has none starts with a mark of its own."""
        if self._odd(text):
            return [chunk[1:] if chunk[:1] == " " else _FIRST + chunk for chunk in self._cut(text)]
        chunks = text.split(" ")
        chunks[0] = _FIRST + chunks[0]
        return chunks

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks; those of their pre-tokens are encoded together, in order."""
        words = self._words
        if len(words) >= CACHE_ENTRIES:
            words.clear()
        pieces = {chunk: self._pieces(chunk[1:] if chunk[:1] == _FIRST else " " + chunk) for chunk in chunks}
        new = sorted({piece.encode("utf-8") for found in pieces.values() for piece in found if piece not in words})
        fresh = dict(zip((piece.decode("utf-8") for piece in new), self.vocabulary.encode_sorted(new)))
        words.update((piece, ids) for piece, ids in fresh.items() if len(piece) <= CACHE_CHUNK)
        return {chunk: b"".join([fresh.get(piece) or words[piece] for piece in found]) for chunk, found in pieces.items()}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        chunks, split = self._chunks, [self._split(text) if text else [] for text in texts]
        found = [list(map(chunks.get, parts)) for parts in split]
        missing = {part for parts, ids in zip(split, found) if None in ids for part, known in zip(parts, ids) if known is None}
        if missing:
            fresh = self._learn(missing)
            for parts, ids in zip(split, found):
                if None in ids:
                    ids[:] = [fresh[part] if known is None else known for part, known in zip(parts, ids)]
            if len(chunks) >= CACHE_ENTRIES:
                chunks.clear()
            chunks.update((chunk, ids) for chunk, ids in fresh.items() if len(chunk) <= CACHE_CHUNK)
        return list(map(b"".join, found))

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]

    @staticmethod
    def groups(texts: list[str]) -> Iterator[list[str]]:
        """The texts in groups of ``GROUP_CHARS`` characters or of one longer text."""
        group, chars = [], 0
        for text in texts:
            if group and chars + len(text) > GROUP_CHARS:
                yield group
                group, chars = [], 0
            group.append(text)
            chars += len(text)
        if group:
            yield group

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def _worker_encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each Python worker; the vocabulary file is a few MB whatever the corpus."""
    return TextEncoder(Vocabulary(read_ranks(path)), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, with ``with_ids``,
    ``ids`` (array of int). A null text counts as empty and has no tokens; repeated
    rows give repeated rows; other columns are not read. Map-only: no shuffle, so
    a hot source or a group of copies needs no care. The vocabulary file has to be
    at ``ranks_path`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(ranks_path, pattern)
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
        for batch in slices(batches, GROUP_CHARS):
            at = 0
            for group in encoder.groups([text or "" for text in batch.column(1).to_pylist()]):
                found = encoder.encode_all(group)
                columns = [batch.column(0).slice(at, len(group))]
                columns.append(pa.array([len(ids) // 4 for ids in found], pa.int64()))
                columns.append(pa.array([hashlib.sha256(ids).hexdigest() for ids in found], pa.string()))
                columns.append(pa.array([hashlib.sha256(encoder.decode(ids)).hexdigest() for ids in found], pa.string()))
                if with_ids:
                    cuts = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in found])])
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"))))
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, names=names)
        # a vocabulary takes seconds to make, but as much memory as a task of another stage may need
        encoder = None
        _worker_encoder.cache_clear()
        released()

    bounded(docs.sparkSession)
    picked = docs.select(id_col, text_col)
    kind = picked.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of encoded texts: ``id_col, bytes``. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _worker_encoder(ranks_path, pattern).vocabulary
        for batch in batches:
            found = [b"".join(map(vocabulary.bytes_of.__getitem__, ids.as_py() or [])) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=[id_col, "bytes"])

    picked = encoded.select(id_col, ids_col)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, bytes binary")
