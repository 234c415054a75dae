"""Language of texts by naive Bayes over character n-grams, counted by Spark on labelled texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a gram, and grams of a language that a model holds: its most frequent ones.
GRAM, HELD = 3, 4_000
OTHER = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """Hashes of a text's grams: lower-cased letters, words parted by one blank."""
    x = np.frombuffer(f" {OTHER.sub(' ', (text or '').lower()).strip()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = np.zeros(max(0, len(x) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(h)]
    return (h ^ h >> np.uint64(29)).view(np.int64)


class LanguageModel:
    """Log probabilities of grams in each language, smoothed by one occurrence, over the grams that any language holds."""

    def __init__(self, names: list[str], held: np.ndarray, weights: np.ndarray, prior: np.ndarray):
        self.names, self.held, self.weights, self.prior = names, held, weights, prior

    def scores(self, text: str | None) -> tuple[str | None, float]:
        """The likeliest language, first in the alphabet of equals, and its probability; by the prior where no gram is held."""
        if not self.names:
            return None, 0.0
        found, n = np.unique(grams(text), return_counts=True)
        at = np.minimum(np.searchsorted(self.held, found), max(0, len(self.held) - 1))
        known = self.held[at] == found if len(self.held) else np.zeros(len(found), bool)
        total = self.prior + n[known] @ self.weights[at[known]]
        likely = np.exp(total - total.max())
        return self.names[int(total.argmax())], round(float(likely.max() / likely.sum()), 6)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of the languages that label some texts. All labelled texts are counted, where they are read.

    Each task counts the grams of its texts for each language; sums are shuffled by language and gram, and the most frequent
    HELD grams of each language come to the driver. Rows without a label or a text count nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list[np.ndarray]] = {}
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own.setdefault(lang, []).append(grams(t.as_py()))
            for lang, some in own.items():
                found, n = np.unique(np.concatenate(some), return_counts=True)
                size, none = len(found) + 1, np.arange(len(found) + 1) == len(found)  # a row without a gram has the number of texts
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(np.append(found, 0), mask=none), pa.array(np.append(n, 0)), pa.array(np.where(none, len(some), 0))], ["lang", "gram", "n", "texts"])

    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    counts = labelled.mapInArrow(count, "lang string, gram long, n long, texts long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    ahead = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    whole = Window.partitionBy("lang")
    rows = counts.select("lang", "gram", "n", ahead.alias("r"), F.sum("n").over(whole).alias("total"), F.sum("texts").over(whole).alias("texts")).where((F.col("r") <= HELD) | F.col("gram").isNull()).select("lang", F.coalesce("gram", F.lit(0)).alias("gram"), F.col("gram").isNotNull().alias("real"), "n", "total", "texts").toPandas()
    names, sizes = sorted(rows["lang"].unique()), rows.drop_duplicates("lang").set_index("lang")
    rows = rows[rows["real"]]
    held = np.unique(rows["gram"].to_numpy(np.int64)) if names else np.empty(0, np.int64)
    weights, prior = np.zeros((len(held), len(names))), np.zeros(len(names))
    for k, name in enumerate(names):
        own = rows[rows["lang"] == name]
        n = np.ones(len(held))
        n[np.searchsorted(held, own["gram"].to_numpy(np.int64))] += own["n"].to_numpy()
        weights[:, k] = np.log(n / (int(sizes["total"][name]) + max(1, len(held))))
        prior[k] = np.log(int(sizes["texts"][name]))
    return LanguageModel(names, held, weights, prior)


def detect(c: Column, model: LanguageModel) -> Column:
    """Language and confidence of a text, in one pass over it; of the type of metadata.detect_language, which it can stand for."""

    @F.pandas_udf("language string, confidence double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.scores(t) for t in texts], columns=["language", "confidence"])

    return run(c)
