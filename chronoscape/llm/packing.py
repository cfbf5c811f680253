"""Vector best-fit packing of tokenised documents into fixed-length sequences.

Two steps. `tokenize_pieces` turns each document into pieces of at most `capacity` tokens (only longer documents are
cut). `pack` deals the pieces into blocks of bounded size by a hash of their key and packs each block on its own:
pieces by falling length, each into the open bin that scores best among those with room in *every* dimension (tokens,
documents, attention cost = sum of squared lengths). No step needs all pieces in one place, and a block that is lost
is packed again to the same bins.

Defined results: null or empty text is the closing id alone; repeated rows are packed as often as they occur; ties
go by length, key and then checksum; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, text_chunks, words

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, block int"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Words:
    """Ids of words in flat arrays: sorted hashes, and where each word's ids begin and how many there are."""

    key: np.ndarray
    at: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, size: np.ndarray, ids: np.ndarray) -> Words:
        return cls(key, np.cumsum(size) - size, size, ids)

    def take(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the words at i."""
        size = self.size[i]
        return size, self.ids[np.repeat(self.at[i] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are here, and where."""
        i = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return (self.key[i] == key if len(self.key) else np.zeros(len(key), bool)), i

    def with_(self, other: Words) -> Words:
        """Both, which have no word in common."""
        key, size = np.concatenate((self.key, other.key)), np.concatenate((self.size, other.size))
        both = Words(key, np.concatenate((self.at, other.at + len(self.ids))), size, np.concatenate((self.ids, other.ids)))
        order = np.argsort(key, kind="stable")
        return Words.of(key[order], *both.take(order))


class WordTokenizer:
    """Ids of whole texts through a bounded cache of words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in a row. A
    word of plain Latin letters, digits and punctuation goes to the BPE model piece by piece; any other word goes
    through the whole tokenizer. What is known lies in flat arrays, about 24 bytes a word: a small part that new words
    are merged into, and a large one. A merge holds both parts several times over, so it is what the bounds are for.
    """

    #: Words kept, new words until they are merged into the others, and parts of words kept; beyond, each starts anew.
    KEEP, RECENT, PARTS = 250_000, 25_000, 50_000
    PLAIN = re.compile(r"[\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    NONE = Words.of(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known, self.recent = self.NONE, self.NONE
        self.parts: dict[str, list[int]] = {}
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves
        shown = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(33, 256)}

    def part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.shown))]
            if len(self.parts) >= self.PARTS:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def encode(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of these words, one after another."""
        plain = lambda t: "<|" not in t and self.PLAIN.fullmatch(t)
        size, flat, all_plain = [], [], plain(" ".join(raw))
        for word in raw:
            if not all_plain and not plain(word):
                ids = self.whole.encode(word, add_special_tokens=False).ids
            elif (word := word.lower()).isalpha():
                ids = self.part(word)
            else:
                ids = [i for part in self.SPLIT.findall(word) for i in self.part(part)]
            size.append(len(ids))
            flat += ids
        return np.array(size, np.int64), np.array(flat, "<u4")

    def look_up(self, key: np.ndarray, read) -> Words:
        """The words of these sorted hashes; read(i) gives those at places i as text."""
        found, left = [], np.ones(len(key), bool)
        for part in (self.known, self.recent):
            there, i = part.find(key)
            found.append(Words.of(key[there], *part.take(i[there])))
            left &= ~there
        new = Words.of(key[left], *self.encode(read(np.flatnonzero(left))))
        if len(new.key):
            self.recent = self.recent.with_(new)
            if len(self.recent.key) > self.RECENT:
                whole = len(self.known.key) + len(self.recent.key) > self.KEEP
                self.known, self.recent = self.recent if whole else self.known.with_(self.recent), self.NONE
        return found[0].with_(found[1]).with_(new)

    def __call__(self, offs: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit arrays."""
        start, end, row, h = words(offs, data, lower=False)
        n = len(offs) - 1
        if not len(h):
            return [np.zeros(0, "<u4")] * n
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        got = self.look_up(key, lambda i: [str(raw[s:e], "utf-8") for s, e in zip(start[first[i]].tolist(), end[first[i]].tolist(), strict=True)])
        size, ids = got.take(back)
        cut = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(row, np.arange(n + 1))]
        return [ids[cut[i] : cut[i + 1]] for i in range(n)]


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 (and ids, if kept) for the columns doc_id and text of docs."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        encode = WordTokenizer(path)
        try:
            yield from pieces(batches, encode)
        finally:
            del encode
            give_back()

    def pieces(batches, encode):
        for batch in batches:
            doc = batch.column(0).to_pylist()
            for at, offs, data in text_chunks(batch.column(1)):
                out, kept = [], []
                for i, ids in enumerate(encode(offs, data)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        out.append((doc[at + i], k, s, len(part), zlib.crc32(part.tobytes())))
                        if keep_ids:
                            kept.append(part)
                cols = list(zip(*out, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array([x.tolist() for x in kept], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return got.mapInArrow(run, PIECES + (", ids array<long>" if keep_ids else ""))


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. The defaults for documents and attention never bind below the token limit."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096


def best_fit(lengths: np.ndarray, cap: Capacity, weights=(1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, items being given by falling length; the number of bins.

    Of the open bins with room in every dimension, "norm" takes the one whose weighted residual after placement has
    the least norm, "dot" the one whose residual has the largest weighted product with the item. The first opened of
    equals wins. An item beyond a capacity on its own is an error.
    """
    caps = np.array([cap.tokens, cap.documents, cap.attention], float)
    w = np.asarray(weights, float) / caps**2
    left = np.empty((1024, 3))
    index = np.empty(1024, np.int64)
    n = bins = 0
    least = lengths[-1] if len(lengths) else 0
    out, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths):
        item = np.array([length, 1, length * length], float)
        if (item > caps).any():
            raise ValueError(f"a piece of {length} tokens is larger than a sequence")
        r = left[:n]
        fits = np.flatnonzero((r[:, 0] >= item[0]) & (r[:, 1] >= 1) & (r[:, 2] >= item[2])) if length < cap.tokens else []
        if len(fits):
            score = ((r[fits] - item) ** 2 * w).sum(1) if rule == "norm" else -(r[fits] * item * w).sum(1)
            j = fits[int(score.argmin())]
        else:
            if n == len(left):
                left, index = np.concatenate((left, np.empty_like(left))), np.concatenate((index, np.empty_like(index)))
            j, index[n], left[n] = n, bins, caps
            bins, n = bins + 1, n + 1
        out[i], offset[i] = index[j], cap.tokens - left[j, 0]
        left[j] -= item
        if left[j, 0] < least or left[j, 1] < 1:  # nothing fits any more
            left[j : n - 1], index[j : n - 1] = left[j + 1 : n].copy(), index[j + 1 : n].copy()
            n -= 1
    return out, offset, bins


def pack(pieces: DataFrame, cap: Capacity = Capacity(), weights=(1.0, 0.01, 0.01), rule: str = "norm", block_rows: int = 16_384) -> DataFrame:
    """Place the pieces (columns of `tokenize_pieces`) into sequences: adds sequence_id, offset and block."""
    blocks = max(1, -(-pieces.count() // block_rows))

    def run(table: pa.Table) -> pa.Table:
        keys = [table.column(c).fill_null(-1).to_numpy() for c in ("ids_crc32", "piece", "doc_id")]
        length = table.column("length").to_numpy()
        order = np.lexsort((*keys, -length))
        where, offset, _ = best_fit(length[order], cap, weights, rule)
        table = table.take(pa.array(order))
        sequence = (table.column("block").to_numpy().astype(np.int64) << 31) + where
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).select(names)

    names = [c.split()[0] for c in PLACED.split(", ")]
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(run, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, cap: Capacity = Capacity(), **options) -> DataFrame:
    """Tokenise docs (doc_id, text) and pack them: one row per piece with its place in a sequence."""
    pieces = materialize(tokenize_pieces(docs, tokenizer, cap.tokens), "pieces")
    return pack(pieces, cap, **options)


def render_sequences(docs: DataFrame, placed: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, of the documents that were packed."""
    ids = tokenize_pieces(docs, tokenizer, capacity, end_id, keep_ids=True).dropDuplicates(["doc_id", "piece", "ids_crc32"])
    parts = placed.join(ids.select("doc_id", "piece", "ids_crc32", "ids"), ["doc_id", "piece", "ids_crc32"])
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda x: x["ids"])).alias("ids"))
