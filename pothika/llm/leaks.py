"""Problem 9: passages of held-out test items that stand in corpus documents.

Size-partitioned MinHash containment search. The indexed sets are the five-word shingles of pieces of the
documents (2W words, every W words, so that each run of W words lies within one piece); a query is a run of W words of
an item. The pieces are partitioned by their number of shingles, and each partition has as many hash functions as it
takes for a piece of its size to share a least value with a query it contains, given that a misspelt word may
spoil five shingles. Items are the short side: where the values of their runs fit a fixed budget, the documents' values are
tested against a bit table of them before anything is shuffled; beyond it both sides are joined as they are.
Candidate pairs are verified on the words themselves: shared shingles give the place, and the run around them is
measured word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, salted_lookup
from .words import folded, plain_words

#: Words of a run that counts, words of a shingle.
RUN, SHINGLE = 12, 5
#: Chance that a contained run is not seen by its partition's hash functions.
MISS = 0.003
#: Upper bounds of the partitions, in shingles of a piece.
PARTS = [2, 4, 8, 12, 16, 2 * RUN - SHINGLE + 1]
#: Values of items kept on the driver for the bit table, and its bits.
ITEM_VALUES, TABLE_BITS = 4_000_000, 26
_MIX = np.uint64(0x9E3779B97F4A7C15)


def functions_of(size: int) -> int:
    """Hash functions for a partition whose pieces have up to `size` shingles."""
    query = RUN - SHINGLE + 1
    shared = max(1, min(query, size) - SHINGLE)  # one word misspelt
    jaccard = shared / (query + size - shared)
    return math.ceil(math.log(MISS) / math.log(1 - jaccard)) if jaccard < 1 else 1


@lru_cache(400_000)
def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(folded(word))


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th permutation of 64-bit values."""
    x = x ^ np.uint64((k * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = x * _MIX
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words; a shorter text is one shingle."""
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = (out ^ words[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def pieces(n_words: int, step: int) -> list[tuple[int, int]]:
    """(start, end) in words. Queries: runs of RUN words at each word; documents: of 2 RUN words, every RUN words."""
    if step == 1:
        return [(s, s + RUN) for s in range(max(1, n_words - RUN + 1))]
    return [(s, min(s + 2 * RUN, n_words)) for s in range(0, max(1, n_words - RUN), RUN)]


def _values(batch: pd.DataFrame, key: str, text: str, step: int, table: np.ndarray | None) -> pd.DataFrame:
    """(key, v): least values of the pieces of each text. v also holds the number of its function."""
    firsts, lasts, owner, hashes, at = [], [], [], [], 0
    for row, t in enumerate(batch[text]):
        words = plain_words(t) if t else []
        if not words:
            continue
        h = shingle_hashes(np.fromiter(map(word_hash, words), np.uint64, len(words)))
        for s, e in pieces(len(words), step):
            firsts.append(at + s)
            lasts.append(at + max(s + 1, min(e - SHINGLE + 1, len(h))))
            owner.append(row)
        hashes.append(h)
        at += len(h)
    if not hashes:
        return pd.DataFrame({key: batch[key].iloc[:0], "v": np.zeros(0, np.int64)})
    h = np.concatenate([*hashes, np.zeros(1, np.uint64)])
    lo, hi, rows = np.array(firsts), np.array(lasts), np.array(owner)
    sizes = hi - lo
    out_rows, out_values = [], []
    lower = 0
    for upper in PARTS:
        # queries ask all partitions, pieces stand in the one of their size
        mine = np.flatnonzero((sizes > lower) & (sizes <= upper)) if step > 1 else np.arange(len(sizes))
        if len(mine):
            bounds = np.empty(2 * len(mine), np.int64)
            bounds[::2], bounds[1::2] = lo[mine], hi[mine]
            for k in range(functions_of(upper)):
                v = _mixed(np.minimum.reduceat(_mixed(h, k), bounds)[::2], 1000 * upper + k)
                if table is not None:
                    seen = table[(v >> np.uint64(67 - TABLE_BITS)).astype(np.int64)] >> ((v >> np.uint64(64 - TABLE_BITS)) & np.uint64(7)).astype(np.uint8) & 1
                    hit = np.flatnonzero(seen)
                    out_rows.append(rows[mine[hit]])
                    out_values.append(v[hit])
                else:
                    out_rows.append(rows[mine])
                    out_values.append(v)
        lower = upper
    if not out_rows:
        return pd.DataFrame({key: batch[key].iloc[:0], "v": np.zeros(0, np.int64)})
    found = pd.DataFrame({"row": np.concatenate(out_rows), "v": np.concatenate(out_values).view(np.int64)}).drop_duplicates()
    return pd.DataFrame({key: batch[key].to_numpy()[found["row"]], "v": found["v"].to_numpy()})


def _sketches(df: DataFrame, key: str, text: str, step: int, table=None) -> DataFrame:
    schema = f"{key} {df.schema[key].dataType.simpleString()}, v bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = table.value if table is not None else None
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                yield _values(batch.iloc[lo : lo + 1000], key, text, step, bits)

    return df.select(key, text).filter(F.col(text).isNotNull()).mapInPandas(run, schema)


def _alike(a: str, b: str) -> bool:
    """Whether b may be a misspelling of a: at most a third of the letters differ."""
    if a == b:
        return True
    n, m = len(a), len(b)
    most = max(n, m) // 3 or (max(n, m) > 1)
    if abs(n - m) > most:
        return False
    row = list(range(m + 1))
    for i in range(1, n + 1):
        left, row[0] = row[0], i
        for j in range(1, m + 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (a[i - 1] != b[j - 1]))
    return row[m] <= most


def longest_run(item: list[str], doc: list[str]) -> int:
    """Most running words of item that stand in doc: seeds are shared shingles, misspelt words count as the same.

    A misspelt word inside the run counts if a right word follows; a word that one side splits or lacks ends the
    run unless the words after it go on within two places.
    """
    item, doc = [folded(w) for w in item], [folded(w) for w in doc]
    k = min(SHINGLE, len(item))
    places: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(item) - k + 1):
        places.setdefault(tuple(item[i : i + k]), []).append(i)
    done: set[tuple[int, int]] = set()
    most = 0
    for j in range(len(doc) - k + 1):
        for i in places.get(tuple(doc[j : j + k]), ()):
            if (i, j) in done:
                continue
            ends = []
            for way in (1, -1):
                a, b = (i + k - 1, j + k - 1) if way > 0 else (i, j)
                while True:
                    moved = False
                    for da, db in ((1, 1), (2, 2), (1, 2), (2, 1), (3, 3)):
                        x, y = a + way * da, b + way * db
                        if not (0 <= x < len(item) and 0 <= y < len(doc)):
                            continue
                        if item[x] == doc[y] and (da == db == 1 or all(_alike(item[a + way * s], doc[b + way * s]) for s in range(1, da)) if da == db else _joined(item, doc, a, b, way, da, db)):
                            for s in range(da):
                                done.add((a + way * s, b + way * s))
                            a, b, moved = x, y, True
                            break
                    if not moved:
                        break
                # a misspelt word at the very end of the run
                if 0 <= a + way < len(item) and 0 <= b + way < len(doc) and _alike(item[a + way], doc[b + way]):
                    a += way
                ends.append(a)
            most = max(most, ends[0] - ends[1] + 1)
    return most


def _joined(item: list[str], doc: list[str], a: int, b: int, way: int, da: int, db: int) -> bool:
    """Whether the word between is written as two on the other side, or the two as one."""
    xs = [item[a + way * s] for s in range(1, da + 1)][::way]
    ys = [doc[b + way * s] for s in range(1, db + 1)][::way]
    return _alike("".join(xs), "".join(ys))


def leaks(items: DataFrame, item: str, documents: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(item, doc, words): documents that hold a whole item, or RUN running words of it; words is the longest run.

    Both tables have a column `text`. Null, empty and wordless texts hold nothing and are found nowhere; an item
    shorter than RUN words must stand whole. Repeated documents are found each, repeated rows of one id once. An empty table gives an
    empty result. Nothing is capped: an item that stands in every document gives a pair for each.
    """
    spark = documents.sparkSession
    values = cut(_sketches(items, item, text, 1).distinct())
    table = None
    if values.limit(ITEM_VALUES + 1).count() <= ITEM_VALUES:
        v = values.select("v").distinct().toPandas()["v"].to_numpy().view(np.uint64)
        bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
        np.bitwise_or.at(bits, (v >> np.uint64(67 - TABLE_BITS)).astype(np.int64), np.uint8(1) << ((v >> np.uint64(64 - TABLE_BITS)) & np.uint64(7)).astype(np.uint8))
        table = spark.sparkContext.broadcast(bits)
    seen = cut(_sketches(documents, doc, text, RUN, table))
    pairs = cut(salted_lookup(seen, values, "v").select(item, doc).distinct())
    with_items = pairs.join(items.select(item, F.col(text).alias("item_text")).dropDuplicates([item]), item)
    # only texts of candidates are moved
    candidates, _ = broadcast_if_small(pairs.select(doc).distinct(), 32)
    both = documents.select(doc, F.col(text).alias("doc_text")).join(candidates, doc, "left_semi").join(with_items, doc)
    schema = f"{item} {items.schema[item].dataType.simpleString()}, {doc} {documents.schema[doc].dataType.simpleString()}, words int"

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, d, a, b in zip(batch[item], batch[doc], batch["item_text"], batch["doc_text"]):
                a = plain_words(a)
                n = longest_run(a, plain_words(b))
                if n >= min(RUN, len(a)):
                    rows.append((i, d, n))
            yield pd.DataFrame(rows, columns=[item, doc, "words"])

    return both.select(item, doc, "item_text", "doc_text").mapInPandas(verify, schema).groupBy(item, doc).agg(F.max("words").alias("words"))
