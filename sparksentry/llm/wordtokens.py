"""Token ids of whole texts by a public tokenizer's library, one encoding per distinct chunk.

A text is cut at ASCII white space.  The vocabularies used here drop white space and never
join across it, so a text's ids are its chunks' ids in order.  Distinct chunks are found by
Arrow, encoded once by the library and remembered in two bounded generations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrowtext import doc_blocks, ragged_sum_index, text_buffers

#: Chunks in each of the two generations that a worker remembers: about 105 MB for each 200,000.
MEMO_CHUNKS = 400_000
TOKEN_BLOCK_BYTES = 4 << 20
_MARK = "\x01"
#: A simple word and punctuation: characters whose case, class and composition no Unicode version changes.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿŒœ]*)([.,;:!?*$%&#|()-]*)")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    def __init__(self, path: str, memo: int = MEMO_CHUNKS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        mark = self.tok.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        if self.tok.encode("a b", add_special_tokens=False).ids != [i for w in "ab" for i in self.tok.encode(w, add_special_tokens=False).ids]:
            raise ValueError("this vocabulary keeps white space; its chunks can't be encoded alone")
        self.memo = memo
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.pieces: dict[str, list[int]] = {}
        self.simple = self._is_simple()
        self.new: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}
        self._reset_pool()

    def _is_simple(self) -> bool:
        """Whether the model on a simple word, and on a run of punctuation, gives what the library gives on the text."""
        words = ["Hello", "the", "été", "œuvre", "ÀßÜ", "Zwölf", "ñandú"]
        by_text = [self.tok.encode(w + "!!", add_special_tokens=False).ids for w in words]
        by_model = [[t.id for p in (w.lower(), "!!") for t in self.tok.model.tokenize(p.encode().decode("latin-1").translate(self.letters))] for w in words]
        return by_text == by_model

    def _reset_pool(self) -> None:
        self.pool, self.pool_n = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lens, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 1
        self.new, self.old = {"": 0}, {}

    def _turn(self) -> None:
        """The newer generation becomes the older one and its ids move to the front of a new pool."""
        keep = list(self.new)
        at = np.fromiter(self.new.values(), np.int64, len(keep))
        lens = self.lens[at]
        pool = self.pool[ragged_sum_index(self.starts[at], lens)]
        self._reset_pool()
        self._grow(lens, pool)
        self.n = 1
        self._append(keep, lens, pool, self.old)
        self.new = {"": 0}

    def _grow(self, lens: np.ndarray, pool: np.ndarray) -> None:
        while self.pool_n + len(pool) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(lens) > len(self.lens):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))

    def _append(self, chunks: list[str], lens: np.ndarray, pool: np.ndarray, into: dict[str, int]) -> None:
        self._grow(lens, pool)
        self.pool[self.pool_n : self.pool_n + len(pool)] = pool
        self.starts[self.n : self.n + len(lens)] = self.pool_n + np.cumsum(lens) - lens
        self.lens[self.n : self.n + len(lens)] = lens
        into.update(zip(chunks, range(self.n, self.n + len(lens))))
        self.pool_n += len(pool)
        self.n += len(lens)

    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids by whole-text encoding of marked joins; texts with a mark or a special go alone."""
        odd = [self.mark is None or _MARK in c or any(s in c for s in self.specials) for c in chunks]
        lens, pools = [], []
        for lo in range(0, len(chunks), 200):
            some = chunks[lo : lo + 200]
            if not any(odd[lo : lo + 200]):
                ids = np.array(self.tok.encode(f" {_MARK} ".join(some), add_special_tokens=False).ids, np.uint32)
                cuts = np.flatnonzero(ids == self.mark)
                if len(cuts) == len(some) - 1:
                    lens.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                    pools.append(ids[ids != self.mark])
                    continue
            for c in some:
                ids = np.array(self.tok.encode(c, add_special_tokens=False).ids, np.uint32)
                lens.append(np.array([len(ids)]))
                pools.append(ids)
        return np.concatenate(lens).astype(np.int64), np.concatenate(pools)

    def _plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Lengths and ids of chunks that are one simple word with simple punctuation behind; the other chunks."""
        lens, pool, rest = [], [], []
        match, tokenize, pieces = _PLAIN.fullmatch, self.tok.model.tokenize, self.pieces
        for c in chunks:
            m = match(c)
            if m is None:
                lens.append(-1)
                rest.append(c)
                continue
            word, tail = m[1].lower(), m[2]
            before = len(pool)
            if word:
                pool += [t.id for t in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]
            if tail:
                if tail not in pieces:
                    if len(pieces) > 10_000:
                        pieces.clear()
                    pieces[tail] = [t.id for t in tokenize(tail)]
                pool += pieces[tail]
            lens.append(len(pool) - before)
        return np.array(lens, np.int64), np.array(pool, np.uint32), rest

    def _encode(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.simple:
            return chunks, *self._library(chunks)
        lens, pool, rest = self._plain(chunks)
        plain = [c for c, n in zip(chunks, lens) if n >= 0]
        lens = lens[lens >= 0]
        if rest:
            more, ids = self._library(rest)
            lens, pool = np.concatenate([lens, more]), np.concatenate([pool, ids])
        return plain + rest, lens, pool

    def _index(self, chunks: list[str]) -> np.ndarray:
        new, old = self.new, self.old
        found = list(map(new.get, chunks))
        late = [i for i, f in enumerate(found) if f is None]
        if late:
            missing = []
            for i in late:
                found[i] = old.get(chunks[i])
                if found[i] is None:
                    missing.append(chunks[i])
            if missing:
                self._append(*self._encode(missing), new)
                for i in late:
                    if found[i] is None:
                        found[i] = new[chunks[i]]
        return np.array(found, np.int64)

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of a string array without nulls."""
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        words_at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = flat.dictionary_encode()
        if len(self.new) > self.memo:
            self._turn()
        index = self._index(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = index[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        lens = self.lens[which]
        ids = self.pool[ragged_sum_index(self.starts[which], lens)]
        tokens_at = np.concatenate([[0], np.cumsum(lens)])[words_at]
        return ids, tokens_at


def encoded_blocks(encoder: ChunkEncoder, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, ids, offsets) for blocks of bounded size; a null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets = text_buffers(texts)
    for first, last in doc_blocks(np.diff(offsets), TOKEN_BLOCK_BYTES):
        ids, at = encoder.block(texts.slice(first, last - first))
        yield first, last, ids, at


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def encoder_of(path: str, memo: int = MEMO_CHUNKS) -> ChunkEncoder:
    """One for each worker process, vocabulary and size of memory, kept for later tasks."""
    if (path, memo) not in _encoders:
        _encoders[path, memo] = ChunkEncoder(path, memo)
    return _encoders[path, memo]
