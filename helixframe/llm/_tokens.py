"""Whole texts to token ids with the ``tokenizers`` library, each different chunk encoded once.

A byte-level tokenizer splits text before any merge, and always between a non-space and a single
space or newline that a non-space follows.  Texts are cut at such places only, chunks are looked
up in a bounded cache, and unseen ones are encoded by the library in batches.  Texts that have
single spaces and newlines only are cut by Arrow, and each different piece is looked up once.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Chunks of one generation of the cache; two are held.
CACHE = 400_000
#: Unseen chunks encoded as one text.
JOINED = 2000
#: Longer texts are handled in parts, so that memory follows the part.
PART = 1 << 20
#: White space other than space and newline.
_OTHERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_OTHER_SPACE = re.compile(f"[{_OTHERS}]")
_JOINABLE = f"(?s)^[ \\n][^ \\n{_OTHERS}](.*[^ \\n{_OTHERS}])?$"
_SIGNS = frozenset(".,;:!?")
#: White space that is more than one space or newline between two pieces.
_ODD = f"^[ \n]|[ \n][ \n]|[ \n]$|[{_OTHERS}]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _gather(store: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of ``store``, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return store[np.repeat(start - (ends - size), size) + np.arange(total)]


class _Lookup(dict):
    """Chunk to its number; unseen chunks are numbered and queued, as what their ids come from."""

    def __init__(self, owner: Encoder, raw: bool, older: dict):
        super().__init__()
        self.owner, self.raw, self.older = owner, raw, older

    def __missing__(self, chunk: str) -> int:
        owner = self.owner
        if (old := self.older.get(chunk)) is not None:
            n = owner.number()
            owner.seen_before.append((n, old))
        elif chunk[-1:] in _SIGNS and chunk[-2:-1].isalpha():
            # a letter and a sign are parted before any merge
            parts = self[chunk[:-1]], owner.raw[chunk[-1]]
            n = owner.number()
            owner.joins.append((n, *parts))
        else:
            n = owner.number()
            owner.unseen.append(chunk if self.raw or chunk[:1] == "\n" else " " + chunk)
            owner.unseen_at.append(n)
        self[chunk] = n
        return n


class Encoder:
    """Token ids of texts, as the library's plain call gives them, special tokens included."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, n in vocabulary.items():
            self.token_bytes[n] = len(token)  # byte-level tokens have a character for each byte
        self.reset()

    def reset(self) -> None:
        """Start a generation; chunks of the last one are copied over when they are seen again."""
        older = {}, {}
        if hasattr(self, "raw"):
            older = self.raw, self.inner
            self.raw.older, self.inner.older = {}, {}
            self.old_start, self.old_size, self.old_ids = self.start, self.size, self.ids
        self.raw, self.inner = _Lookup(self, True, older[0]), _Lookup(self, False, older[1])
        self.clear_queue()
        self.known = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def clear_queue(self) -> None:
        self.unseen: list[str] = []
        self.unseen_at: list[int] = []
        self.seen_before: list[tuple[int, int]] = []
        self.joins: list[tuple[int, int, int]] = []

    def number(self) -> int:
        self.known += 1
        return self.known - 1

    def _merged(self, pieces: list[str], inner: bool) -> list[int]:
        """Numbers of chunks where white space other than single spaces and newlines occurs."""
        out, held, held_inner = [], pieces[0], inner
        for before, piece in zip(pieces, pieces[1:], strict=False):
            body = piece[1:] if piece[:1] == "\n" else piece
            if body and not body[0].isspace() and before and not before[-1].isspace():
                out.append((self.inner if held_inner else self.raw)[held])
                held, held_inner = piece, True
            else:
                held += piece if piece[:1] == "\n" else " " + piece
        out.append((self.inner if held_inner else self.raw)[held])
        return out

    def _numbers(self, text: str) -> np.ndarray:
        out, inner = [], False
        while text:
            part, text = text, ""
            if len(part) > PART:
                at = PART
                while 0 <= (at := part.find(" ", at)) < len(part) - 1:
                    if not part[at - 1].isspace() and not part[at + 1].isspace():
                        part, text = part[:at], part[at + 1 :]
                        break
                    at += 1
            pieces = part.replace("\n", " \n").split(" ")
            if "" in pieces or "\n" in pieces or _OTHER_SPACE.search(part):
                out.append(np.array(self._merged(pieces, inner), np.int64))
            elif inner:
                out.append(np.fromiter(map(self.inner.__getitem__, pieces), np.int64, len(pieces)))
            else:
                out.append(np.array([self.raw[pieces[0]]], np.int64))
                out.append(np.fromiter(map(self.inner.__getitem__, pieces[1:]), np.int64, len(pieces) - 1))
            inner = True
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _encode_strings(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in one array, and how many each has.

        Chunks that start at a place where texts may be cut, and end before one, are encoded
        joined; each token's bytes tell where a chunk ends.
        """
        every = pa.array(chunks, pa.large_string())
        joinable = pc.match_substring_regex(every, _JOINABLE).to_numpy(zero_copy_only=False)
        n_bytes = pc.binary_length(every).to_numpy()
        size, ids = np.zeros(len(chunks), np.int64), []
        own = np.flatnonzero(joinable)
        groups = [own[i : i + JOINED] for i in range(0, len(own), JOINED)]
        texts = ["".join([chunks[i] for i in g]) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            found = np.array(found.ids, np.uint32)
            ends = np.cumsum(n_bytes[group])
            reached = np.cumsum(self.token_bytes[found])
            last = np.searchsorted(reached, ends)
            if not np.array_equal(reached[last], ends):
                raise ValueError("a token crosses a place where texts were cut")
            size[group] = np.diff(last, prepend=-1)
            ids.append(found)
        rest = np.flatnonzero(~joinable).tolist()
        if rest:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)]
            size[rest] = [len(x) for x in found]
            ids += found
        order = np.concatenate([own, np.array(rest, np.int64)])
        joined = np.concatenate(ids)
        starts = np.empty_like(size)
        starts[order] = np.cumsum(size[order]) - size[order]
        return _gather(joined, starts, size), size

    def _append(self, numbers: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Store the ids of the chunks ``numbers``."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[numbers] = size
        self.start[numbers] = self.used + np.cumsum(size) - size
        self.used += len(ids)

    def _encode_queued(self) -> None:
        while self.known > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        if self.unseen:
            self._append(np.array(self.unseen_at), *self._encode_strings(self.unseen))
        if self.seen_before:
            numbers, source = np.array(self.seen_before).T
            size = self.old_size[source]
            self._append(numbers, _gather(self.old_ids, self.old_start[source], size), size)
        if self.joins:
            numbers, *parts = np.array(self.joins).T
            source = np.column_stack(parts).ravel()
            size = self.size[source]
            self._append(numbers, _gather(self.ids, self.start[source], size), size[::2] + size[1::2])
        self.clear_queue()

    def _even_numbers(self, texts: pa.Array) -> list[np.ndarray]:
        """Numbers of chunks of texts without odd white space."""
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        edge = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        every = pieces.flatten()
        later = np.ones(len(every), bool)
        later[edge[:-1]] = False
        out = np.empty(len(every), np.int64)
        out[edge[:-1]] = [self.raw[x] for x in every.take(pa.array(edge[:-1])).to_pylist()]
        coded = every.filter(pa.array(later)).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        out[later] = np.array([self.inner[x] for x in different], np.int64)[coded.indices.to_numpy()]
        return np.split(out, edge[1:-1])

    def encode_flat(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end`` after it, and where texts start; null is empty."""
        if self.known > CACHE:
            self.reset()
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.greater(pc.binary_length(texts), PART)).to_numpy(zero_copy_only=False)
        numbers = np.empty(len(texts), object)
        for i in np.flatnonzero(odd).tolist():
            numbers[i] = self._numbers(texts[i].as_py())
        even = np.flatnonzero(~odd)
        if len(even):
            for i, found in zip(even.tolist(), self._even_numbers(texts.take(pa.array(even))), strict=True):
                numbers[i] = found
        self._encode_queued()
        chunk = np.concatenate([np.zeros(0, np.int64), *numbers])
        size = self.size[chunk]
        of = np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
        total = np.bincount(of, size, len(texts)).astype(np.int64)
        start = np.concatenate(([0], np.cumsum(total + 1)))
        ids = np.full(start[-1], end, np.uint32)
        inside = np.ones(len(ids), bool)
        inside[start[1:] - 1] = False
        ids[inside] = _gather(self.ids, self.start[chunk], size)
        return ids, start

    def encode(self, texts: list[str | None] | pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text with ``end`` after them, as unsigned 32-bit integers."""
        ids, start = self.encode_flat(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), end)
        return np.split(ids, start[1:-1]) if len(start) > 1 else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, and so one cache, per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
