"""Token counts by a whole-token shortcut.

For a SentencePiece BPE model whose pieces never hold a space mark after another character, no merge crosses
from a word into the next space; nor does one touch a line feed if no piece holds it beside other characters.
A text is cut at these places into pre-tokens, and its count is the sum over them. Which vocabulary strings
encode alone as one token is proved once, by encoding each; pre-tokens that equal one of them count as 1 by a
lookup, and only the rest are merged, each distinct one once while the memo holds it.

Models for which the cuts can't be proved safe are counted over whole texts instead. Null and empty texts have no
tokens. Strings of special tokens inside a text are ordinary text, as the library takes them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import map_rows, text_or_empty

#: Entries of a generation of the memo of merged pre-tokens; the generation before is kept.
MEMO = 300_000
SPACE = "▁"


class PieceCounter:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.cuts = self._safe(pieces)
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.proved = self._prove(pieces) if self.cuts else {}

    def _safe(self, pieces: list[str]) -> bool:
        """Spaces become marks and nothing else changes; no piece has a mark after another character, or a line feed."""
        probe = " a  B \ufb01 "
        plain = "".join(self.model.encode(probe, out_type=str)) == SPACE + probe.replace(" ", SPACE) and not self.model.encode("")
        return plain and not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces)

    def _prove(self, pieces: list[str]) -> dict[str, int]:
        """The vocabulary strings that stand for one token when they are a whole pre-token."""
        return {p: 1 for p, n in zip(pieces, self._merge(pieces), strict=True) if n == 1}

    def _merge(self, words: list[str]) -> list[int]:
        """Counts of pre-tokens. The library puts a space mark before each text; a line feed parts it from ours, and both are taken off."""
        return [len(x) - 2 for x in self.model.encode(["\n" + w.replace(SPACE, " ") for w in words], num_threads=1)] if words else []

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []
        parts = [self._cut(t) for t in texts]
        proved, memo = self.proved, self.memo
        if len(memo) >= MEMO:
            self.old, self.memo = memo, (memo := {})
        new = set().union(*parts) - memo.keys()
        rest = []
        for word in new:
            if (n := proved.get(word) or self.old.get(word)) is None:
                rest.append(word)
            else:
                memo[word] = n
        memo.update(zip(rest, self._merge(rest), strict=True))
        return [sum(map(memo.__getitem__, p)) for p in parts]

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Runs of space marks with what follows them, and line feeds apart."""
        if not text:
            return []
        return re.findall(f"{SPACE}+[^{SPACE}\\n]*|\\n|[^{SPACE}\\n]+", SPACE + text.replace(" ", SPACE))


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens)."""

    def rows(part: pa.RecordBatch) -> dict:
        texts = part.column("text").to_pylist()
        counts = counter(path).count(texts)
        return {"id": part.column("id"), "n_bytes": pa.compute.binary_length(part.column("text")), "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), "text", f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", rows).withColumnRenamed("id", id_col)
