"""Problem 8: the whole corpus encoded with a public byte-pair tokenizer.

The encoding of every byte prefix ends in one token only, so an array with the last token of each prefix holds
the encoding of all prefixes at once; reading it from the end gives the encoding of the text. The last token of a
prefix is the one whose predecessor (the last token of the prefix before it) stays apart from it when both are
merged. Appending bytes extends the array; an edit leaves the part before it, and behind it encoding runs only
until the arrays agree again over the length of the longest token.

The tokenizer's pattern splits text into pieces before the merges, so the array is kept per piece, and pieces are
encoded once per task and kept in a table of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept per task; when the table is full it starts anew, which costs time only.
KEPT = 200_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The path of a public vocabulary file in the installed package of them."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Splits text into pieces; fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder with a vocabulary file of merges; ids grow in the order of the merges."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.token: dict[bytes, int] = {bytes([b]): ids[c] for c, b in letters.items()}
        for a, b in pairs:
            whole = ids[a + b]
            self.merged[ids[a], ids[b]] = whole
            self.parts[whole] = ids[a], ids[b]
            self.token[bytes(letters[c] for c in a + b)] = whole
        self.longest = max(map(len, self.token))
        self.apart_known: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PATTERN)

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their joint bytes.

        They are not if some merge across the border comes before the merge that made the token on one of its
        sides; both are taken apart from the younger one down until the border holds single bytes.
        """
        key = left, right
        known = self.apart_known.get(key)
        if known is not None:
            return known
        a, b, before = left, right, 1 << 60
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < before:
                known = False
                break
            split_a, split_b = a in self.parts, b in self.parts
            if not split_a and not split_b:
                known = True
                break
            # the younger side is undone first; with equal tokens merges run from the left, so the right one is
            if split_a and (not split_b or a > b):
                before, a = min(before, a), self.parts[a][1]
            else:
                before, b = min(before, b + 1), self.parts[b][0]
        if len(self.apart_known) > 1_000_000:
            self.apart_known.clear()
        self.apart_known[key] = known
        return known

    def extend(self, data: bytes, last: list[int], size: list[int]) -> None:
        """Append to last and size the last token, and its length, of each prefix of data not yet there."""
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                t = self.token.get(data[start:end])
                if t is not None and (start == 0 or self.apart(last[start - 1], t)):
                    last.append(t)
                    size.append(end - start)
                    break

    def encode_piece(self, data: bytes) -> list[int]:
        last: list[int] = []
        size: list[int] = []
        self.extend(data, last, size)
        return read_back(last, size)

    def encode(self, text: str) -> list[int]:
        return [t for piece in self.pieces.findall(text) for t in self.encode_piece(piece.encode())]


def read_back(last: list[int], size: list[int]) -> list[int]:
    out, at = [], len(last)
    while at:
        out.append(last[at - 1])
        at -= size[at - 1]
    return out[::-1]


class EditablePiece:
    """Bytes with the prefix array beside them: appends and edits re-encode only what they touch."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last, self.size = encoder, b"", [], []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.encoder.extend(self.data, self.last, self.size)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put data in the place of bytes start to end; gives the number of prefixes encoded anew."""
        tail_last, tail_size = self.last[end:], self.size[end:]
        self.data = self.data[:start] + data + self.data[end:]
        del self.last[start:], self.size[start:]
        behind, same = start + len(data), 0
        for at in range(start, len(self.data)):
            self.encoder.extend(self.data[: at + 1], self.last, self.size)
            k = at - behind
            same = same + 1 if k >= 0 and (self.last[at], self.size[at]) == (tail_last[k], tail_size[k]) else 0
            # the next prefixes depend on the last `longest` ones only
            if same >= self.encoder.longest:
                self.last += tail_last[k + 1 :]
                self.size += tail_size[k + 1 :]
                return at + 1 - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        return read_back(self.last, self.size)


def encoded(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): every row with the ids of its text, without special tokens; empty and null text give [].

    The text is encoded as stored, strings that look like special tokens are ordinary text. Repeated rows give
    repeated rows.
    """
    path = path or vocabulary_path()
    schema = f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = PrefixEncoder(path)
        findall, encode_piece = encoder.pieces.findall, encoder.encode_piece
        number: dict[str, int] = {}  # of each kept piece
        flat: list[int] = []
        begins: list[int] = [0]
        as_array = (0, np.zeros(0, np.int32), np.zeros(1, np.int64))

        def ids_of(pieces: list[str]) -> np.ndarray:
            """The ids of all pieces, one after the other, and how many each piece has."""
            nonlocal as_array
            try:
                at = [number[p] for p in pieces]
            except KeyError:
                for p in pieces:
                    if p not in number:
                        number[p] = len(number)
                        flat.extend(encode_piece(p.encode("utf-8", "surrogatepass")))
                        begins.append(len(flat))
                at = [number[p] for p in pieces]
            if as_array[0] != len(number):
                as_array = len(number), np.array(flat, np.int32), np.array(begins, np.int64)
            _, ids, starts = as_array
            at = np.array(at, np.int64)
            sizes = starts[at + 1] - starts[at]
            ends = np.cumsum(sizes)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - sizes), sizes)
            return ids[take], ends

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):  # bounds the memory of the ids
                part = texts[lo : lo + 256]
                if len(number) > KEPT:
                    number.clear(), flat.clear()
                    begins[:] = [0]
                    as_array = (-1, as_array[1], as_array[2])
                pieces: list[str] = []
                counts = np.zeros(len(part) + 1, np.int64)
                for i, t in enumerate(part):
                    if t:
                        pieces += findall(t)
                    counts[i + 1] = len(pieces)
                ids, ends = ids_of(pieces)
                offsets = np.concatenate(([0], ends))[counts].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, len(part)), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)
