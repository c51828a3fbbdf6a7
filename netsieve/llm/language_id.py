"""Language identification with word-first backoff.

A word that the model knows scores, in each language, the logarithm of its
smoothed relative frequency there. An unseen word falls back to its character
n-grams: the longest ones (``Limits.longest``) first, and where one is unknown
to the n-grams one character shorter that it consists of, down to single
characters; the word then scores the mean over the places that were known. The
language with the highest sum over a text's words is predicted, and the score
is its share of the softmax of the mean scores per word, scaled by the square
root of the number of words. A word is a run of letters (``\\p{L}``) in lower
case, cut by the same code when the model learns and when it predicts.

The model is fitted on a bounded sample of the labelled rows (by a hash of id
and text: about ``Limits.rows`` of each language, ``Limits.total`` of all) and
holds every word and n-gram of it, so its size follows the sample and not the
input. It holds counts only for the languages that a unit was seen in, and is
broadcast. Every text is read whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
with no labelled rows every text is; a text of which nothing is known takes the
first language by name with score 1 / languages; ties go to the first by name;
null ids hash as empty; repeated rows count as often as they are repeated.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.llm.shared import text_batches

WORD = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class Limits:
    """Rows sampled of each language and of all, longest n-gram, added counts, unseen words that a worker remembers."""

    rows: int = 1000
    total: int = 200_000
    longest: int = 4
    smoothing: float = 0.5
    memo: int = 200_000


#: Of a unit: how much more it scores in a language (by number) than a unit never seen there.
Gains = tuple[tuple[int, float], ...]


@dataclass(frozen=True)
class Units:
    """Gains of words or n-grams, and what a unit scores in each language that it was never seen in."""

    gains: dict[str, Gains]
    unseen: tuple[float, ...]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    words: Units
    grams: Units
    longest: int


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(word: str, longest: int) -> list[str]:
    """All n-grams of a word, a space standing for either end of it."""
    padded = f" {word} "
    return [padded[at : at + n] for n in range(1, longest + 1) for at in range(len(padded) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """(gram, unit, lang, n) of the words and n-grams of each batch of (lang, text), added up within it."""
    for batch in batches:
        words: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for word, n in Counter(words_of(text.as_py())).items():
                words[lang, word] += n
        grams: Counter = Counter()
        for (lang, word), n in words.items():
            for part in grams_of(word, longest):
                grams[lang, part] += n
        for is_gram, counts in ((False, words), (True, grams)):
            columns = [is_gram] * len(counts), [unit for _, unit in counts], [lang for lang, _ in counts], list(counts.values())
            types = pa.bool_(), pa.string(), pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["gram", "unit", "lang", "n"])


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", limits: Limits | None = None) -> Model:
    """A model from the rows of docs that have a text and a language."""
    limits = limits or Limits()
    longest = limits.longest
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # the languages are part of the model
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), Units({}, ()), Units({}, ()), longest)
    # a row is in the sample by its own hash alone: of a language with n rows a share of rows / n
    each = min(limits.rows, limits.total / len(languages))
    known = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    share = F.get(F.array(*[F.lit(min(1.0, each / sizes[lang])) for lang in languages]), F.col("lang"))
    sample = rows.withColumn("lang", F.element_at(known, F.col("lang"))).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    counts = sample.select("lang", "text").mapInArrow(lambda batches: _counted(batches, longest), "gram boolean, unit string, lang int, n long")
    by_unit = counts.groupBy("gram", "unit", "lang").agg(F.sum("n").alias("n")).groupBy("gram", "unit").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
    found = by_unit.toArrow()  # as much as the units of the sample
    units = [(g, u, [(x["lang"], x["n"]) for x in by]) for g, u, by in zip(*(found.column(c).to_pylist() for c in ("gram", "unit", "by")), strict=True)]
    return Model(languages, *(_units([(u, by) for g, u, by in units if g == is_gram], len(languages), limits.smoothing) for is_gram in (False, True)), longest)


def _units(counts: list[tuple[str, list[tuple[int, int]]]], languages: int, smoothing: float) -> Units:
    """Smoothed log frequencies of units relative to all of their kind."""
    total = [0] * languages
    for _, by in counts:
        for lang, n in by:
            total[lang] += n
    unseen = tuple(math.log(smoothing) - math.log(n + smoothing * (len(counts) + 1)) for n in total)
    return Units({unit: tuple((lang, math.log((n + smoothing) / smoothing)) for lang, n in sorted(by)) for unit, by in counts}, unseen)


class Scorer:
    """Scores with one model, remembering unseen words."""

    def __init__(self, model: Model, memo: int) -> None:
        self.model, self.memo, self.most = model, {}, memo

    def _gram(self, gram: str) -> list[Gains]:
        known = self.model.grams.gains.get(gram)
        if known is not None:
            return [known]
        if len(gram) == 1:
            return []
        return self._gram(gram[:-1]) + self._gram(gram[1:])

    def _unseen(self, word: str) -> Gains | None:
        """The mean gains of a word's n-grams; None if none is known."""
        padded, n = f" {word} ", self.model.longest
        found = [x for k in range(max(1, len(padded) - n + 1)) for x in self._gram(padded[k : k + n])]
        sums: Counter = Counter()
        for gains in found:
            for lang, gain in gains:
                sums[lang] += gain
        return tuple((lang, gain / len(found)) for lang, gain in sums.items()) if found else None

    def unseen(self, word: str) -> Gains | None:
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) >= self.most:
            self.memo.clear()
        gains = self._unseen(word)
        if len(word) <= 64:
            self.memo[word] = gains
        return gains

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        languages, known = self.model.languages, self.model.words.gains.get
        if not words or not languages:
            return "und", 0.0
        sums, whole, parts = [0.0] * len(languages), 0, 0
        for word, times in Counter(words).items():
            gains = known(word)
            if gains is not None:
                whole += times
            elif (gains := self.unseen(word)) is not None:
                parts += times
            for lang, gain in gains or ():
                sums[lang] += times * gain
        sums = [x + whole * a + parts * b for x, a, b in zip(sums, self.model.words.unseen, self.model.grams.unseen, strict=True)]
        n = whole + parts
        scale = math.sqrt(n) / n if n else 0.0
        best = max(range(len(languages)), key=lambda k: (sums[k], -k))
        return languages[best], 1 / sum(math.exp((x - sums[best]) * scale) for x in sums)


def predict(text: Column | str, model: Model, spark: SparkSession, limits: Limits | None = None) -> Column:
    """struct<lang_pred, score> of a text column."""
    shared, memo = spark.sparkContext.broadcast(model), (limits or Limits()).memo

    @F.arrow_udf("lang_pred string, score double")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value, memo)
        for texts in batches:
            found = [scorer.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    return language(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score): a model fitted on the rows that are not held out, applied to all."""
    text_batches(docs.sparkSession)
    model = fit(docs.where(~held_out(id_col)), lang_col, text_col, id_col, limits)
    found = predict(text_col, model, docs.sparkSession, limits).alias("_found")
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), found).select(id_col, "held_out", "_found.*")
