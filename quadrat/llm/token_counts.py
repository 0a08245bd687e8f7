"""Token counts by heap-and-list byte-pair merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk is some blanks and what follows up to the next blank or line feed. No
#: piece holds a blank behind another character, and none holds a line feed, so
#: no merge crosses a chunk's border.
CHUNKS = re.compile(" *[^ \n]+|\n| +")
CACHED = 600_000


class PairCounter(dict):
    """Chunk -> number of tokens under a piece model; counts are kept per process.

    ``ranks`` gives a piece's merge rank, lower first. A symbol outside the
    vocabulary falls back to its UTF-8 bytes, one token each.
    """

    def __init__(self, model_file: str):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ranks = {model.id_to_piece(i).replace("▁", " "): -model.get_score(i) for i in ids}
        bad = [p for p in self.ranks if " " in p.lstrip(" ") or "\n" in p]
        if bad:
            raise ValueError(f"pieces cross chunk borders: {bad[:3]}")

    def __missing__(self, chunk: str) -> int:
        n = self.count(chunk)
        if len(chunk) <= 48:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = n
        return n

    def count(self, chunk: str) -> int:
        """Initial symbols minus merges.

        Symbols form a doubly linked list; a heap holds adjacent pairs by rank,
        then place. A popped pair whose symbols have changed is stale.
        """
        ranks = self.ranks
        symbols = list(chunk)
        size = len(symbols)
        tokens = sum(1 if s in ranks else len(s.encode()) for s in symbols)
        if size < 2:
            return tokens
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, p) for i, p in enumerate(map("".join, zip(symbols, symbols[1:]))) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            j = after[i]
            if not left or j >= size or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            tokens -= 1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                new = pair + symbols[k]
                if (r := ranks.get(new)) is not None:
                    heapq.heappush(heap, (r, i, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + pair
                if (r := ranks.get(new)) is not None:
                    heapq.heappush(heap, (r, h, new))
        return tokens

    def tokens(self, text: str | None) -> int:
        """Tokens of a text; the model puts one blank before a text that isn't empty."""
        if not text:
            return 0
        return sum(map(self.__getitem__, CHUNKS.findall(" " + text.replace("▁", " "))))


@lru_cache(2)
def counter(model_file: str) -> PairCounter:
    """One counter per Python worker."""
    return PairCounter(model_file)


def count_tokens(
    df: DataFrame, model_file: str, limit: int = 4096, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every text under a sentencepiece BPE model.

    Counts whole texts in place: no shuffle, no identifiers. A null text counts
    as empty (0 bytes, 0 tokens). A null or repeated key keeps one row per input
    row; an empty table gives no row; other columns are ignored. A text of one
    word of any length is one chunk, merged in n log n steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file)
        for batch in batches:
            n = [count.tokens(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(
        F.col(key).alias("key"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).cast("string").alias("text"),
    ).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
