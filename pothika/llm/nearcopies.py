"""Problem 4: records that are near copies of one another, among all records.

Equal texts are one class first. Each class has a 256-bit signature of its letter 4-grams and BANDS routing keys,
each made of two least hash values of them. The classes of one key are a shard, and the shard's BK-tree on the
signatures (children keyed by the integer Hamming distance to their parent) is searched for each of its members,
following only edges within the radius. A shard's tree is shipped to the tasks that hold its members: as trees grow
with the data they are not broadcast to all. Shards above BLOCK members are cut into blocks, with a tree each, and
every block of members visits the tree of every block, so a hot key is spread over tasks and loses no pair. What
the trees find is verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .agreement import compared_words, matched, size

#: Routing keys of two least values each; radius in bits of 256; members of a tree.
BANDS, RADIUS, BLOCK = 30, 96, 2048
#: Share of letters that must agree.
AGREE = 0.8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ np.uint64((k * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))) * _A
    x ^= x >> np.uint64(32)
    return x * _B


def grams(text: str) -> np.ndarray:
    """Hashes of the overlapping 4-grams of a text; a shorter text is one gram."""
    c = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    if len(c) < 4:
        c = np.concatenate([c, np.zeros(4 - len(c), np.uint64)])
    return _mixed(c[:-3] | c[1:-2] << np.uint64(16) | c[2:-1] << np.uint64(32) | c[3:] << np.uint64(48), 0)


def signature(g: np.ndarray) -> bytes:
    """256 bits, each the majority of the bits that the grams have there."""
    bits = np.unpackbits(np.stack([_mixed(g, k) for k in range(1, 5)], 1).view(np.uint8), axis=1)
    return np.packbits(bits.sum(0, dtype=np.int32) * 2 > len(g)).tobytes()


def routing_keys(g: np.ndarray) -> np.ndarray:
    least = np.array([_mixed(g, 10 + k).min() for k in range(2 * BANDS)], np.uint64)
    return _mixed(least[::2] ^ (least[1::2] * _A), 7).view(np.int64) ^ np.arange(BANDS)


class Tree:
    """BK-tree on integers under Hamming distance. Equal integers stand in one node."""

    def __init__(self):
        self.root: list | None = None  # [value, members, {distance: node}]

    def add(self, value: int, member) -> None:
        if self.root is None:
            self.root = [value, [member], {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if not d:
                node[1].append(member)
                return
            child = node[2].get(d)
            if child is None:
                node[2][d] = [value, [member], {}]
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator:
        """Members at most radius away."""
        stack = [self.root] if self.root else []
        while stack:
            at, members, children = stack.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield from members
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, i, j, role): a tree's members (role 0), then those that visit it (1). Gives pairs (a, b), a < b."""
    key, tree, out = None, Tree(), []
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("k", "i", "j", "role", "cls", "sig")]
        for k, i, j, role, cls, sig in zip(*cols):
            if (k, i, j) != key:
                key, tree = (k, i, j), Tree()
            value = int.from_bytes(sig)
            if i == j:
                # one block: each member visits the tree of those before it
                out += [(min(cls, x), max(cls, x)) for x in tree.within(value, RADIUS)]
                tree.add(value, cls)
            elif role == 0:
                tree.add(value, cls)
            else:
                out += [(min(cls, x), max(cls, x)) for x in tree.within(value, RADIUS)]
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
    if out:
        yield _pairs(out)


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    out = list(dict.fromkeys(out))
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def classes_of(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, cls, words_key): records that have both texts; equal folded texts have equal cls, the least key of them."""

    @F.pandas_udf("string")
    def words_key(a: pd.Series, b: pd.Series) -> pd.Series:
        sides = [(compared_words(x), compared_words(y)) for x, y in zip(a, b)]
        return pd.Series([f"{' '.join(x)} {' '.join(y)}" if x and y else None for x, y in sides], dtype=object)

    both = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).select(key, words_key(first, second).alias("words_key")).filter("words_key is not null")
    both = cut(both)
    least = both.groupBy("words_key").agg(F.min(key).alias("cls"))
    return both.join(least, "words_key").select(key, "cls", "words_key")


def class_links(classes: DataFrame, agree: float = AGREE) -> DataFrame:
    """(a, b, agreement), a < b: classes of different texts that agree in at least `agree` of their letters."""
    texts = classes.filter(F.col(classes.columns[0]) == F.col("cls")).select("cls", "words_key").dropDuplicates(["cls"])

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sigs, keys = [], [], []
            for c, t in zip(batch["cls"], batch["words_key"]):
                g = grams(t.replace(" ", ""))
                ids += [c] * BANDS
                sigs += [signature(g)] * BANDS
                keys.append(routing_keys(g))
            yield pd.DataFrame({"cls": ids, "sig": sigs, "k": np.concatenate(keys) if keys else np.zeros(0, np.int64)})

    rows = cut(texts.mapInPandas(sketch, "cls bigint, sig binary, k bigint"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    shards = rows.join(sizes, "k").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # block x is the tree of tasks (x, y) and visits those of tasks (w, x), for all w <= x <= y
    trees = shards.select("k", "cls", "sig", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("role"))
    visits = shards.filter("block > 0").select("k", "cls", "sig", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("role"))
    tasks = trees.unionByName(visits).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "role", "cls")
    near = cut(tasks.select("k", "i", "j", "role", "cls", "sig").mapInArrow(_searched, "a bigint, b bigint").distinct())
    left, right = texts.select(F.col("cls").alias("a"), F.col("words_key").alias("ta")), texts.select(F.col("cls").alias("b"), F.col("words_key").alias("tb"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"]):
                x, y = tuple(ta.split()), tuple(tb.split())
                got.append((a, b, matched(x, y)[0] / max(size(x), size(y), 1)))
            yield pd.DataFrame([g for g in got if g[2] >= agree], columns=["a", "b", "agreement"])

    return near.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(verify, "a bigint, b bigint, agreement double")


def near_copies(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, class_id, copies, links): a row for each record with both texts, linear in the records.

    copies: records of its class; links: other classes that the class agrees with.
    """
    classes = cut(classes_of(df, key, first, second))
    links = cut(class_links(classes))
    ends = links.select(F.col("a").alias("cls")).union(links.select("b")).groupBy("cls").agg(F.count("*").alias("links"))
    return classes.join(classes.groupBy("cls").agg(F.count("*").alias("copies")).join(ends, "cls", "left"), "cls").select(
        key, F.col("cls").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links")
    )


def near_copy_pairs(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(a, b), a < b: all pairs of records that are equal or near copies.

    Records that lack a text (null, empty or without letters) are in no pair; a repeated row of one key makes no
    pair with itself; an empty table gives none.
    """
    classes = cut(classes_of(df.dropDuplicates([key]), key, first, second))
    members = classes.select(F.col(key).alias("m"), "cls")
    links = class_links(classes).select("a", "b")
    x, y = members.select(F.col("m").alias("m1"), F.col("cls").alias("a")), members.select(F.col("m").alias("m2"), F.col("cls").alias("b"))
    across = links.join(x, "a").join(y, "b").select(F.least("m1", "m2").alias("a"), F.greatest("m1", "m2").alias("b"))
    equal = x.join(y.withColumnRenamed("b", "a"), "a").filter("m1 < m2").select(F.col("m1").alias("a"), F.col("m2").alias("b"))
    return across.union(equal)
