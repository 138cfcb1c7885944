"""Language identification by rank-order profiles.

A profile is a list of the most frequent letter n-grams (one to three letters of words with their edges) in order.  A
document's own profile is compared to each language's: the distance is the sum over its n-grams of how far out of place
each is, and the length of the profile for one that is missing.  The nearest language wins.

Profiles come from a bounded sample of texts per language, chosen by hash of the id; their counts are summed on Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, kept, slices, texts_of

FOLDS = 4
HELD_OUT = 2
PROFILE = 300
LONGEST = 3
PER_LANGUAGE = 3000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 200_000
GRAMS = 1_000_000


class Grams:
    """Numbers of n-grams and, per word, the numbers of its n-grams; grows with what a worker sees, forgets when full."""

    def __init__(self):
        self.words: dict[str, np.ndarray] = {}
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.ties = np.zeros(1 << 12, np.int64)
        self.ranks: dict = {}

    def of_word(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is None:
            edged = f"_{word}_"
            grams = [edged[k : k + n] for n in range(1, LONGEST + 1) for k in range(len(edged) - n + 1)]
            found = self.words[word] = np.array([self.of_gram(g) for g in grams if g != "_"], np.int64)
        return found

    def of_gram(self, gram: str) -> int:
        i = self.number.get(gram)
        if i is None:
            i = self.number[gram] = len(self.names)
            self.names.append(gram)
            if i >= len(self.ties):
                self.ties = np.r_[self.ties, np.zeros_like(self.ties)]
            self.ties[i] = crc32(gram.encode())
        return i

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of a text's n-grams."""
        if len(self.words) > REMEMBERED or len(self.names) > GRAMS:
            self.__init__()
        words = Counter(WORD.findall(text.lower()))
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = [self.of_word(w) for w in words]
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(p) for p in parts])
        grams = np.concatenate(parts)
        if len(grams) * 4 > len(self.names):
            total = np.bincount(grams, times).astype(np.int64)
            numbers = np.flatnonzero(total)
            return numbers, total[numbers]
        numbers, at = np.unique(grams, return_inverse=True)
        return numbers, np.bincount(at, times).astype(np.int64)

    def top(self, text: str, size: int) -> np.ndarray:
        """A text's profile.  Equal counts go by a checksum of the n-gram, so the order is the same everywhere."""
        numbers, counts = self.counts(text)
        if len(numbers) > size:
            least = np.partition(counts, len(counts) - size)[len(counts) - size]
            numbers, counts = numbers[counts >= least], counts[counts >= least]
        return numbers[np.lexsort((self.ties[numbers], -counts))[:size]]

    def table(self, profiles: dict[str, dict[str, int]], size: int) -> np.ndarray:
        """Rank of each numbered n-gram in each language; -1: not in the profile."""
        if self.ranks.get("of") is not profiles:
            for gram in {g for ranks in profiles.values() for g in ranks}:
                self.of_gram(gram)
            self.ranks = {"of": profiles, "table": np.zeros((len(profiles), 0), np.int64)}
        if (table := self.ranks["table"]).shape[1] < len(self.names):
            table = np.full((len(profiles), 2 * len(self.names)), -1, np.int64)  # room for n-grams that are in no profile
            for row, ranks in zip(table, profiles.values()):
                row[[self.number[g] for g in ranks]] = list(ranks.values())
            self.ranks["table"] = table
        return table


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) % FOLDS == HELD_OUT


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, size: int = PROFILE) -> dict[str, dict[str, int]]:
    """Profiles {language: {n-gram: rank}} from rows outside the held-out fold with a language.

    Each language gives about ``per_language`` rows: those whose hash of the id lies below the share that leaves so many.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null").where(F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    shares = rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("share")).collect()  # a row a language
    share = {r["lang"]: r["share"] for r in shares}
    if not share:
        return {}
    allowed = F.element_at(F.create_map(*[F.lit(x) for p in share.items() for x in p]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("profiles")), F.lit(1_000_000)) < allowed * 1_000_000)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                numbers, counts = grams.counts(text)
                total.setdefault(lang, Counter()).update(dict(zip(map(grams.names.__getitem__, numbers.tolist()), counts.tolist())))
            if sum(map(len, total.values())) > GRAMS:
                yield from flush(total)
        yield from flush(total)

    def flush(total: dict) -> Iterator[pa.RecordBatch]:
        for lang, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])
        total.clear()

    sums = chosen.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.crc32(F.col("gram").cast("binary")), "gram")
    ranked = sums.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    profiles: dict[str, dict[str, int]] = {lang: {} for lang in sorted(share)}
    for r in ranked.collect():  # ``size`` rows a language
        profiles[r["lang"]][r["gram"]] = r["rank"]
    return profiles


def distances(top: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Out-of-place distance of a profile to each language."""
    ranks = table[:, top]
    return np.where(ranks < 0, size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)


def identify(docs: DataFrame, profiles: dict[str, dict[str, int]], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (1: in the same order as the profile, 0: nothing in common) of every row.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned.  Of equally near languages
    the first by name wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, profiles = kept("language grams", Grams), shared.value
        names = list(profiles)
        for batch in slices(batches):
            langs, scores = [], []
            for text in texts_of(batch):
                top = grams.top(text, size) if names else ()
                if not len(top):
                    langs.append(UNKNOWN), scores.append(0.0)
                    continue
                far = distances(top, grams.table(profiles, size), size)
                best = int(far.argmin())
                langs.append(names[best]), scores.append(1.0 - float(far[best]) / (size * len(top)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(told, "doc_id long, lang_pred string, score double")
