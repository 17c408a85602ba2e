"""Token counts by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a batch lie one after the other in one symbol array.  In each
round every sequence finds its lowest-rank adjacent pair and all sequences merge theirs at
once; sequences without a mergeable pair leave.  The count of a text is the sum of the
surviving symbols of its pre-tokens.

Null and empty texts have 0 tokens and 0 bytes.  Repeated rows are counted each on its own;
a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrowtext import doc_blocks, text_buffers
from .frames import map_arrow, prepare
from .wordtokens import _PLAIN, MEMO_CHUNKS, TOKEN_BLOCK_BYTES, _byte_letters, tokenizer_path

NO_RANK = np.int32(2**31 - 1)
#: Pre-tokens merged together.
MERGE_PIECES = 100_000


class RankMerger:
    """Symbols, ranks and products of a byte-level BPE vocabulary in a tokenizers file."""

    def __init__(self, path: str):
        model = json.load(open(path))["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = left * self.width + right
        self.product = np.array([vocab[a + b] for a, b in merges], np.int32)
        ranks = np.arange(len(merges), dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], ranks[order]
        first = np.full(self.width, len(merges), np.int64)
        np.minimum.at(first, left, ranks)
        np.minimum.at(first, right, ranks)
        #: A merge whose product takes part only in later merges: all its places in a sequence can be merged at once.
        self.at_once = first[self.product] > ranks
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """The symbols left of each piece, none of which is empty."""
        out = np.zeros(len(pieces), np.int64)
        sizes = np.array([len(p) for p in pieces], np.int64)
        sym = self.inner[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.final[np.frombuffer(b"".join(pieces), np.uint8)[ends - 1]]
        who, at = np.arange(len(pieces)), ends - sizes
        rank = np.full(len(sym), NO_RANK, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[ends - 1] = NO_RANK
        while len(who):
            low = np.minimum.reduceat(rank, at)
            live = low < NO_RANK
            if not live.all():
                out[who[~live]] = sizes[~live]
                keep = np.repeat(live, sizes)
                sym, rank, who, sizes, low = sym[keep], rank[keep], who[live], sizes[live], low[live]
                if not len(who):
                    break
                at = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(who)), sizes)
            chosen = np.flatnonzero(rank == low[owner])
            # of places side by side (a run of one symbol) every second one stays
            begins = np.diff(chosen, prepend=-2) != 1
            run = np.maximum.accumulate(np.where(begins, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            single = ~self.at_once[rank[chosen]]
            if single.any():
                again = np.diff(owner[chosen], prepend=-1) == 0
                chosen = chosen[~(single & again)]
            sym[chosen] = self.product[rank[chosen]]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            ended = np.zeros(len(sym), bool)
            ended[at + sizes - 1] = True
            ended[chosen] |= ended[chosen + 1]
            changed = np.zeros(len(sym), bool)
            changed[chosen] = True
            sizes = sizes - np.bincount(owner[chosen], minlength=len(who))
            sym, rank, ended, changed = sym[keep], rank[keep], ended[keep], changed[keep]
            at = np.cumsum(sizes) - sizes
            new = np.flatnonzero(changed)
            redo = np.unique(np.concatenate([new, new[new > 0] - 1]))
            inside = redo[~ended[redo]]
            rank[redo] = NO_RANK
            rank[inside] = self.rank(sym[inside], sym[inside + 1])
        return out


class TokenCounter:
    def __init__(self, path: str, memo: int = MEMO_CHUNKS):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)  # its normaliser and pre-tokeniser serve unusual characters; its model is not used
        self.normalise, self.pre_tokenise = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        specials = [re.escape(t.content) for t in library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(specials)) if specials else None
        self.bytes_of = {c: b for b, c in enumerate(_byte_letters())}
        self.merger, self.memo = RankMerger(path), memo
        self.new: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}

    def _pieces(self, chunk: str) -> tuple[int, list[bytes]]:
        """The special tokens in a chunk, and its pre-tokens as bytes."""
        if m := _PLAIN.fullmatch(chunk):
            return 0, [p.encode() for p in (m[1].lower(), m[2]) if p]
        parts = self.special.split(chunk) if self.special else [chunk]
        out = []
        for part in parts:
            for piece, _ in self.pre_tokenise(self.normalise(part)) if part else ():
                out.append(bytes(self.bytes_of[c] for c in piece))
        return len(parts) - 1, [p for p in out if p]

    def _count(self, chunks: list[str]) -> np.ndarray:
        own: dict[bytes, int] = {}
        total, whose, which = np.zeros(len(chunks), np.int64), [], []
        for i, c in enumerate(chunks):
            total[i], pieces = self._pieces(c)
            for p in pieces:
                whose.append(i)
                which.append(own.setdefault(p, len(own)))
        pieces = list(own)
        counts = [self.merger.count(pieces[lo : lo + MERGE_PIECES]) for lo in range(0, len(pieces), MERGE_PIECES)]
        if counts:
            total += np.bincount(whose, np.concatenate(counts)[which], len(chunks)).astype(np.int64)
        return total

    def block(self, texts: pa.Array) -> np.ndarray:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.new) > self.memo:
            self.new, self.old = {"": 0}, self.new
        new, old = self.new, self.old
        found = [n if (n := new.get(c)) is not None else old.get(c) for c in chunks]
        missing = [c for f, c in zip(found, chunks) if f is None]
        if missing:
            new.update(zip(missing, self._count(missing).tolist()))
            found = [new[c] if f is None else f for f, c in zip(found, chunks)]
        sums = np.concatenate([[0], np.cumsum(np.array(found, np.int64)[coded.indices.to_numpy(zero_copy_only=False)])]) if chunks else np.zeros(1, np.int64)
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return np.diff(sums[at])


_counters: dict[str, TokenCounter] = {}


def counter_of(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_array(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of every text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets = text_buffers(texts)
    tokens = np.zeros(len(texts), np.int64)
    for first, last in doc_blocks(np.diff(offsets), TOKEN_BLOCK_BYTES):
        tokens[first:last] = counter_of(path).block(texts.slice(first, last - first))
    return np.diff(offsets), tokens


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of (doc_id, text)."""
    prepare(docs.sparkSession)
    path = vocabulary or tokenizer_path("word_bpe_49k.json")

    def of_batch(batch: pa.RecordBatch) -> dict:
        n_bytes, n_tokens = count_array(batch.column("text"), path)
        return {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": n_tokens > limit}

    return map_arrow(docs.select("doc_id", "text"), of_batch, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
