"""Language identification, words first: known words count by their frequency in each language, unseen words back off to
ever shorter character n-grams.

The model is learned from a bounded sample per language and has a bounded size, so it can be sent to all tasks; texts
are scored whole where they are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veneer.llm.common import crc_of_id, cut_lineage, table

_LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between its borders; single characters come without borders."""
    w = word if n == 1 else f"^{word}$"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[int, dict[str, np.ndarray]]
    cached: int = 300_000
    _index: dict[str, int] = field(default_factory=dict)
    _rows: np.ndarray | None = None

    def word_scores(self, word: str) -> np.ndarray:
        """Log frequency by language, from the word itself or from its longest n-grams that any language has."""
        known = self.words.get(word)
        if known is not None:
            return known
        for n in sorted(self.grams, reverse=True):
            found = [v for v in map(self.grams[n].get, grams(word, n)) if v is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages))

    def classify(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not found or not self.languages:
            return UNKNOWN, 0.0
        if self._rows is None or len(self._index) + len(found) > self.cached:
            self._index, self._rows = {}, np.zeros((self.cached + len(found), len(self.languages)))
        index, ids = self._index, []
        for w in found:
            i = index.get(w)
            if i is None:
                i = index[w] = len(index)
                self._rows[i] = self.word_scores(w)
            ids.append(i)
        mean = self._rows[ids].mean(axis=0)
        # words of a text depend on each other: it counts as 20 independent ones at most
        odds = np.exp((mean - mean.max()) * min(len(found), 20))
        best = int(np.argmax(odds))
        return self.languages[best], float(odds[best] / odds.sum())


def _log_frequencies(rows, languages: list[str]) -> dict[str, np.ndarray]:
    """Smoothed log share of each entry in each language's total, from (language, entry, count) rows."""
    place = {x: i for i, x in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}
    for lang, entry, n in rows:
        counts.setdefault(entry, np.zeros(len(languages)))[place[lang]] += n
    if not counts:
        return {}
    total = np.sum(list(counts.values()), axis=0)
    return {e: np.log((c + 0.1) / (total + 0.1 * len(counts))) for e, c in counts.items()}


def train(docs: DataFrame, docs_per_language: int = 3000, words_per_language: int = 40_000, grams_per_language: int = 20_000,
          max_gram: int = 4) -> Model:
    """Learns from `docs` (doc_id, text, lang; all labelled). About `docs_per_language` texts of each language are read,
    chosen by a hash of the id and weighed whole; the most frequent words and n-grams of each language are kept."""
    counts = cut_lineage(docs.groupBy("lang").count())
    n_languages = counts.count()
    rates = counts.select("lang", (F.lit(float(docs_per_language)) / F.col("count")).alias("rate"))
    share = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text")), F.lit(1_000_003)) / 1_000_003.0)
    # one row per language: sent to all tasks only while that is few
    chosen = docs.join(F.broadcast(rates) if n_languages <= 10_000 else rates, "lang").filter(share < F.col("rate"))

    def count_words(batches):
        for batch in batches:
            c: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for w, n in Counter(words(text or "")).items():
                    c[lang, w] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.string()),
                                              pa.array(list(c.values()), pa.int64())], ["lang", "entry", "n"])

    def count_grams(batches):
        for batch in batches:
            c: Counter = Counter()
            for lang, w, n in zip(*[batch.column(x).to_pylist() for x in ("lang", "entry", "n")]):
                for size in range(1, max_gram + 1):
                    for g in grams(w, size):
                        c[lang, size, g] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.int32()),
                                              pa.array([k[2] for k in c], pa.string()), pa.array(list(c.values()), pa.int64())],
                                             ["lang", "size", "entry", "n"])

    schema = "lang string, entry string, n long"
    vocabulary = cut_lineage(chosen.select("lang", "text").mapInArrow(count_words, schema).groupBy("lang", "entry").agg(F.sum("n").alias("n")))
    by_lang = Window.partitionBy("lang").orderBy(F.col("n").desc(), "entry")
    known = vocabulary.withColumn("k", F.row_number().over(by_lang)).filter(F.col("k") <= words_per_language)
    parts = (vocabulary.mapInArrow(count_grams, "lang string, size int, entry string, n long")
             .groupBy("lang", "size", "entry").agg(F.sum("n").alias("n")))
    by_size = Window.partitionBy("lang", "size").orderBy(F.col("n").desc(), "entry")
    parts = parts.withColumn("k", F.row_number().over(by_size)).filter(F.col("k") <= grams_per_language)
    # both have at most a fixed number of rows per language
    word_rows = [(r["lang"], r["entry"], r["n"]) for r in known.select("lang", "entry", "n").toLocalIterator()]
    gram_rows = [(r["lang"], r["size"], r["entry"], r["n"]) for r in parts.select("lang", "size", "entry", "n").toLocalIterator()]
    languages = sorted({r[0] for r in word_rows})
    by_n = {n: _log_frequencies([(a, e, c) for a, s, e, c in gram_rows if s == n], languages) for n in range(1, max_gram + 1)}
    return Model(languages, _log_frequencies(word_rows, languages), by_n)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score; one row per row. Null texts and texts without letters are `und` with score 0, as is
    everything if nothing was learned; ties go to the first language in alphabetical order. Ids are not read."""
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.words, model.grams))
    schema = T.StructType([base.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            found = [own.classify(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], schema.names)

    return base.mapInArrow(run, schema)


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    model = train(docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": query}
ORACLES: dict[str, str] = {}
