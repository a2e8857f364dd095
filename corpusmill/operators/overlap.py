"""Words that a text shares with the one of the next id.

Cases: a null or empty text has no words; ids without a successor, null ids, and pairs without a common word give no row; rows of one id
count as one text; empty tables give nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A block holds 2 ** BITS neighbouring ids, and gets the first text of the next block, which is all that travels twice.
BITS = 6
#: Rows of one batch of results.
ROWS = 8192


def _common(a: Counter, b: Counter) -> int:
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return sum(min(n, b[w]) for w, n in a.items() if w in b)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Counter]]:
    """(block, id, counted words) of batches that are sorted by block and id."""
    at, held = None, Counter()
    for batch in batches:
        for block, key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if at is not None and at != (block, key):
                yield *at, held
                held = Counter()
            at = block, key
            held.update(w for w in (words.as_py() or "").split(" ") if w)
    if at is not None:
        yield *at, held


def common_with_next(texts: DataFrame, key: str, words: str, distinct: bool = False) -> DataFrame:
    """key and common: how many of the blank-separated words a text shares with that of the next key, as multisets, or each word once.

    Whole texts are dealt by blocks of neighbouring keys and sorted; a task walks through them and holds the words of two at a time."""
    at = F.col(key).cast("long")
    own, first = F.shiftright(at, BITS), at.bitwiseAND(F.lit((1 << BITS) - 1)) == 0
    blocks = F.when(first, F.array(own, own - 1)).otherwise(F.array(own))
    dealt = texts.where(F.col(key).isNotNull()).select(at.alias("id"), F.col(words).alias("words"), F.explode(blocks).alias("block"))
    dealt = dealt.select("block", "id", "words").repartition("block").sortWithinPartitions("block", "id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, before = [], None
        for block, at, counted in _ids(batches):
            if before is not None and before[:2] == (block, at - 1):
                common = len(before[2].keys() & counted.keys()) if distinct else _common(before[2], counted)
                if common:
                    out.append((at - 1, common))
            before = block, at, counted
            if len(out) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=[key, "common"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=[key, "common"])

    return dealt.mapInArrow(walk, f"{key} long, common long")
