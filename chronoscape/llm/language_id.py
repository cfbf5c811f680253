"""Language identification by words first, then shorter and shorter character n-grams.

The labelled texts give counts of words by language; the counts of n-grams (one to `longest` letters, words padded by a
space on both sides) follow from the counts of words. The model keeps the commonest pairs of a language and a word, and
of a language and an n-gram of each length, with the decimal log of their share in that language. A text's score for a
language is the mean over its words: a known word counts by its log share, and by -`penalty` in languages that do not
have it; a word that no language knows counts by the mean over its longest n-grams of which any is known.

All labelled rows are counted, whole texts. The number of pairs kept is a documented bound of the classifier, so its
size does not grow with the corpus; what scoring reads is all of every text. Words are runs of letters in lower case; a
word of over 64 letters counts as words of 64. A text is read in pieces that end at white space (a text of over 2^20
bytes without any is cut between characters).

Null text, and text without letters, is `und` with score 0, and so is everything if no text is labelled. If not even a
letter of a text is known, the language with most words stands, with score 1 / languages. Rows without doc_id are
neither held out nor learned from; rows without lang are not learned from. Repeated rows get equal results, each its own.
Only `doc_id`, `text` and `lang` are read, so other columns cannot clash."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

LETTERS = re.compile(r"[^\W\d_]{1,64}")
WORDS, GRAMS, LONGEST, PENALTY = 100_000, 40_000, 5, 7.0
PIECE, ENTRIES = 1 << 20, 300_000
_GAP = re.compile(rb"[\x20\x09-\x0D][^\x20\x09-\x0D]*\Z")


def text_pieces(column: pa.Array) -> Iterator[list[str]]:
    """For each row the text in pieces, so that no long text is held twice; none for null."""
    if len(column) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    valid = column.is_valid().to_pylist()
    _, offs, data = column.buffers() if len(column) else (None, None, None)
    offs = np.frombuffer(offs, np.int64)[column.offset :] if offs is not None else []
    data = memoryview(data) if data is not None else memoryview(b"")
    for i, ok in enumerate(valid):
        yield _cut(data, int(offs[i]), int(offs[i + 1])) if ok else iter(())


def _cut(data: memoryview, at: int, end: int) -> Iterator[str]:
    while at < end:
        stop = min(at + PIECE, end)
        if stop < end:
            gap = _GAP.search(data[at:stop]) if stop - at <= PIECE else None
            if gap and gap.start():
                stop = at + gap.start()
            else:
                while data[stop] & 0xC0 == 0x80:
                    stop -= 1
        yield bytes(data[at:stop]).decode("utf-8", "replace").lower()
        at = stop


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over whole texts; each task adds up before rows are shuffled."""

    def count(batches):
        sums: dict[str, Counter] = {}
        entries = 0

        def flush():
            for lang, words in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
            sums.clear()

        for batch in batches:
            for lang, pieces in zip(batch.column(0).to_pylist(), text_pieces(batch.column(1))):
                own = sums.setdefault(lang, Counter())
                for piece in pieces:
                    entries -= len(own)
                    own.update(LETTERS.findall(piece))
                    entries += len(own)
                    if entries > ENTRIES:
                        yield from flush()
                        own, entries = sums.setdefault(lang, Counter()), 0
        yield from flush()

    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).dropna()
    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def grams(word: str, size: int) -> list[str]:
    padded = f" {word} " if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def gram_counts(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, size, key, n: n-grams of the counted words."""

    def count(batches):
        sums: Counter = Counter()

        def flush():
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "size", "key", "n"])
            sums.clear()

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for size in range(1, longest + 1):
                    for g in grams(word, size):
                        sums[lang, size, g] += n
                if len(sums) > ENTRIES:
                    yield from flush()
        if sums:
            yield from flush()

    return words.select("lang", "word", "n").mapInArrow(count, "lang string, size int, key string, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: dict[int, int]) -> DataFrame:
    """Of the pairs of each size, those whose count reaches the least step (a twelfth of doubling) at which there are at most `most` of them; with log share."""
    step = F.floor(F.log2("n") * 12).cast("int")
    steps = counts.groupBy("size", step.alias("step")).agg(F.count("*").alias("pairs")).collect()  # some hundreds of rows, whatever the corpus
    keep = F.lit(False)
    for size, room in most.items():
        least = None
        for s in sorted((s for s in steps if s["size"] == size), key=lambda s: -s.step):
            room -= s.pairs
            if room < 0:
                break
            least = s.step
        if least is not None:
            keep = keep | ((F.col("size") == size) & (step >= least))
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    return counts.where(keep).join(totals, ["lang", "size"]).select("lang", "size", "key", F.log10(F.col("n") / F.col("total")).alias("share"))


class Model:
    """Words (size 0) and n-grams with the languages that have them and how much better than -penalty they are there."""

    def __init__(self, table: pa.Table, first: str | None, penalty: float = PENALTY, longest: int = LONGEST):
        table = table.sort_by([("size", "ascending"), ("key", "ascending"), ("lang", "ascending")])
        lang, size, key = table.column("lang").to_pylist(), table.column("size").to_pylist(), table.column("key").to_pylist()
        self.languages = sorted(set(lang) | ({first} if first is not None else set()))
        number = {name: i for i, name in enumerate(self.languages)}
        self.lang = np.array([number[x] for x in lang], np.int64)
        self.gain = np.maximum(0, penalty + table.column("share").to_numpy())
        names = list(zip(size, key))
        starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
        self.names = [names[i] for i in starts]
        self.ptr = np.array([*starts, len(names)], np.int64)
        self.first, self.longest = first, longest

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """A task's use of the model; what it found out about unseen words is kept for at most `ENTRIES` words."""

    def __init__(self, model: Model):
        self.model, self.at, self.unseen = model, {name: i for i, name in enumerate(model.names)}, {}
        self.words = {key: i for (size, key), i in self.at.items() if size == 0}

    def backoff(self, word: str) -> list[int]:
        found = self.unseen.get(word)
        if found is None:
            found = []
            for size in range(self.model.longest, 0, -1):
                found = [i for g in grams(word, size) if (i := self.at.get((size, g))) is not None]
                if found:
                    break
            if len(self.unseen) >= ENTRIES:
                self.unseen.clear()
            self.unseen[word] = found
        return found

    def scores(self, words: Counter) -> np.ndarray | None:
        """Mean log share of the words by language, from -penalty up; None if nothing is known."""
        rows, weights, n = [], [], 0
        for word, count in words.items():
            i = self.words.get(word)
            if i is not None:
                rows.append(i)
                weights.append(count)
                n += count
            elif found := self.backoff(word):
                rows += found
                weights += [count / len(found)] * len(found)
                n += count
        if not n:
            return None
        m, r, w = self.model, np.array(rows), np.array(weights, float)
        size = m.ptr[r + 1] - m.ptr[r]
        flat = np.repeat(m.ptr[r], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return np.bincount(m.lang[flat], m.gain[flat] * np.repeat(w, size), len(m.languages)) / n

    def predict(self, pieces) -> tuple[str, float]:
        words: Counter = Counter()
        total, seen = np.zeros(len(self.model.languages)), 0
        unknown = False
        for piece in pieces:
            words.update(LETTERS.findall(piece))
            if len(words) > ENTRIES:  # a long text: add up so far
                s, n = self.scores(words), sum(words.values())
                total, seen, unknown = (total + s * n, seen + n, unknown) if s is not None else (total, seen, True)
                words.clear()
        if words:
            s, n = self.scores(words), sum(words.values())
            total, seen, unknown = (total + s * n, seen + n, unknown) if s is not None else (total, seen, True)
        if not self.model.languages or not (seen or unknown):
            return "und", 0.0
        if not seen:
            return self.model.first, 1 / len(self.model.languages)
        mean = total / seen
        best = int(mean.argmax())  # ties: the first name
        return self.model.languages[best], float(1 / (10 ** (mean - mean[best])).sum())


def fit(labelled: DataFrame, words: int = WORDS, ngrams: int = GRAMS, longest: int = LONGEST, penalty: float = PENALTY) -> Model:
    """A model of at most `words` pairs of language and word, and `ngrams` of language and n-gram of each length."""
    counted = materialize(word_counts(labelled), "language-words")
    parts = materialize(gram_counts(counted, longest), "language-grams")
    every = counted.select("lang", F.lit(0).alias("size"), F.col("word").alias("key"), "n").unionByName(parts)
    table = commonest(every, {0: words} | dict.fromkeys(range(1, longest + 1), ngrams)).toArrow()
    first = counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").first()
    drop_table(counted, parts)
    return Model(table, first.lang if first else None, penalty, longest)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def read(batches):
        reader = model.reader()
        for batch in batches:
            found = [reader.predict(p) for p in text_pieces(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learns from the labelled rows that are not held out and predicts the language of all; `options` go to `fit`."""
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    return predict(docs, fit(learn, **options))
