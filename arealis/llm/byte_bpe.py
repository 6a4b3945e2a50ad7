"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes stand as Latin-1 characters in a pyahocorasick trie, so that one prefix walk gives the longest
vocabulary entry at a position. A greedy run takes longest matches and steps back to shorter ones when two
adjacent tokens could not stand side by side after the merges. That test undoes merges on both sides of
the boundary and is memoised by token pair. Each position is left at most once, and a greedy run reaches no further
than SPAN bytes and the longest entry, so the time is linear in the length of a pre-token, and the tokens are those
of merging by rank.

Defined results: null and empty texts have no tokens; equal texts have equal tokens; pre-tokens of any
length are encoded whole. Columns of the input other than the id and the text are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import map_rows, text_or_empty

#: Entries of a generation of the memo of pre-tokens (the one before is kept), and of the memo of token pairs.
MEMO = 150_000
#: Bytes of a pre-token that one greedy run covers.
SPAN = 64


class ByteBPE:
    """Encoder and decoder for a rank file and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
            self.trie.add_word(piece.decode("latin-1"), rank)
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: list[int] = [-1] * len(self.pieces)
        self.sizes = [len(p) for p in self.pieces]
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.longest = max(self.sizes, default=1)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._learn()
        self.trie.make_automaton()

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _learn(self) -> None:
        """For each entry its longest proper prefix in the vocabulary, and the pair of entries whose merge makes it."""
        ranks = self.ranks
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(len(piece) - 1, 0, -1):
                if (left := ranks.get(piece[:cut])) is not None:
                    self.shorter[rank] = left
                    break
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[rank] = (rank, rank)
            left = self.shorter[rank]
            while left >= 0:
                right = ranks.get(piece[len(self.pieces[left]) :])
                if right is not None and left < rank and right < rank and self._test(left, right):
                    self.joined[left, right] = rank
                    self.parts[rank] = (left, right)
                    break
                left = self.shorter[left]

    def _test(self, left: int, right: int) -> bool:
        """May the two stand side by side? Undo merges, latest first; none across the boundary may have come before."""
        bound = len(self.pieces) + 1
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            inner, outer = self.parts[left][1], self.parts[right][0]
            if inner == left and outer == right:
                return True
            if outer == right or (inner != left and left > right):
                bound, left = left, inner
            else:
                bound, right = right + 1, outer

    def _greedy(self, text: str, at: int) -> list[int]:
        """Longest matches from a place on, for SPAN bytes at least; every byte is an entry, so they cover the text."""
        if len(text) <= SPAN:
            return [rank for _, rank in self.trie.iter_long(text[at:])]
        out: list[int] = []
        for end, rank in self.trie.iter_long(text[at : at + SPAN + self.longest]):
            out.append(rank)
            if end >= SPAN - 1:
                break
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        """The tokens of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, sizes, shorter, known = data.decode("latin-1"), self.sizes, self.shorter, self.fits
        if len(known) >= MEMO:
            known.clear()
        ahead = self._greedy(text, 0)
        out: list[int] = []
        dead: set[int] = set()
        at, last, step, token, total = 0, -1, 0, ahead[0], len(data)
        while True:
            end = at + sizes[token]
            if end in dead:
                fits = False
            elif last < 0:
                fits = True
            elif (fits := known.get(last << 20 | token)) is None:
                fits = known[last << 20 | token] = self._test(last, token)
            if fits:
                out.append(token)
                if end == total:
                    return out
                longest = ahead[step] == token
                at, last, step = end, token, step + 1
                if not longest or step == len(ahead):  # look ahead anew
                    ahead, step = self._greedy(text, at), 0
                token = ahead[step]
            elif (less := shorter[token]) >= 0:
                token = less
            else:
                while less < 0:  # step back to a token that has a shorter one
                    dead.add(at)
                    token = out.pop()
                    at -= sizes[token]
                    less = shorter[token]
                token, last, step, ahead = less, out[-1] if out else -1, 0, [-1]

    def encode_bytes(self, text: str) -> bytes:
        """The tokens of a text as little-endian 32-bit integers."""
        memo, pieces = self.memo, self.split(text)
        try:
            return b"".join([memo[p] for p in pieces])
        except KeyError:
            if len(memo) >= MEMO:
                self.old, self.memo = memo, (memo := {})
            old = self.old
            for p in pieces:
                if p not in memo:
                    memo[p] = old.get(p) or pack(f"<{len(ids := self.encode_piece(p.encode()))}I", *ids)
            return b"".join([memo[p] for p in pieces])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(2)
def coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE.load(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Per row: id, `ids` (the tokens) and, unless left out, `decoded` (the bytes that these give back)."""

    def rows(part: pa.RecordBatch) -> dict:
        bpe = coder(path, pattern)
        packed = [bpe.encode_bytes(t) for t in part.column("text").to_pylist()]
        ids = [np.frombuffer(p, "<u4") for p in packed]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
        flat = np.concatenate(ids).astype("i4") if ids else np.empty(0, "i4")
        out = {"id": part.column("id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
        return out | {"decoded": [bpe.decode(x.tolist()) for x in ids]} if decoded else out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), "text", f"id {kind}, ids array<int>" + ", decoded binary" * decoded, rows).withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, made beside the tokens so that these need not leave the worker."""

    def rows(part: pa.RecordBatch) -> dict:
        bpe = coder(path, pattern)
        out: dict = {"id": part.column("id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in part.column("text").to_pylist():
            packed = bpe.encode_bytes(text)
            out["n_tokens"].append(len(packed) // 4)
            out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), "text", f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows).withColumnRenamed("id", id_col)
