"""Per-document text quality statistics, and a classifier of prose against lists, tables and junk (problem 8).

``text_statistics`` reads every text once, in Arrow batches: characters are classified by table look-up and all counts are sums
over blocks of texts (``photoloom.llm.textstats``).  ``train`` fits gradient-boosted trees to weakly labelled documents.  A weak
label is given only where independent kinds of evidence (layout, vocabulary, form of words, ends of lines) agree; where they do
not, it stays open, and the trees decide.  Each tree sees a third of the statistics, so that documents with a mixture of evidence
that no labelled one has are judged by all of it.  The probabilities are calibrated (a logistic curve on the trees' margin) on a
holdout of texts that were read and labelled by hand (``photoloom.llm.holdout``) and are left out of the training.  Training uses
a bounded sample (``SAMPLE`` rows by hash, a parameter); statistics, labels and scores cover every document.

Defined results
---------------
* null, empty and blank texts: statistics null, probability null, no case.
* soft hyphens are ignored, any line end counts, any run of white space parts words; texts are read whole, whatever their length.
* ties and repeated rows: every row is judged alone; equal texts have equal results. An empty table gives an empty result.
* a corpus without plain examples of one of the kinds trains no trees; the margin is then the balance of the evidence, calibrated
  in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoloom.llm.textstats import STATISTICS, CommonWords, content_hash, statistics
from photoloom.llm.trees import Boosted, fit_boosted
from photoloom.session import cut

#: Most rows that the trees are fitted to.
SAMPLE = 20_000
#: A document is a case from this probability.
CASE = 0.5
#: The list of common words is a fixed table; it is sent to every task, so its size is checked.
MOST_COMMON = 1_000_000


def evidence(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many kinds of evidence, of four each, speak for structure and for prose (rows of ``STATISTICS``; NaN speaks for nothing)."""
    c = dict(zip(STATISTICS, x.T, strict=True))
    with np.errstate(invalid="ignore"):
        layout = np.fmax(c["listed_share"], c["gapped_share"])
        structure = [layout > 0.8, (c["common_words"] < 0.05) & (c["word_count"] >= 20), c["plain_share"] < 0.4, (c["line_count"] >= 5) & (c["line_length"] < 25) & (c["punctuated_lines"] < 0.1)]
        prose = [layout < 0.1, c["common_words"] > 0.2, c["plain_share"] > 0.85, c["punctuated_lines"] > 0.5]
    return np.sum(structure, axis=0), np.sum(prose, axis=0)


def weak_label(x: np.ndarray) -> np.ndarray:
    """1 where two kinds of evidence speak for structure and at most one for prose, 0 where three speak for prose and none for
    structure, else -1 (open)."""
    s, p = evidence(x)
    return np.where((s >= 2) & (p <= 1), 1, np.where((p >= 3) & (s == 0), 0, -1))


def text_statistics(documents: DataFrame, common: CommonWords, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, content (a hash of the text), the columns ``STATISTICS`` and weak (-1 for open, null for a blank text).

    word_count, mean_word_length (characters), symbol_ratio and digit_ratio (of all but white space), punctuated_lines (share of
    lines that end as sentences do), common_words (share of words in ``common``), line_count, line_length (median, characters),
    listed_share and gapped_share (share of the text in lines that begin like list items, or are parted like table rows),
    single_share (words of one character), numeric_share (words with digits), capital_share (words whose first letter is a
    capital), plain_share (words of letters, but for punctuation at their ends), broken_share (symbols within words, and symbols
    that prose does not have, for each word), vowel_ratio, longest_word.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = statistics(texts, common)
            blank = np.isnan(x[:, 0])
            columns = [batch.column(0), pa.array([None if t is None else content_hash(t) for t in texts], pa.int64())]
            columns += [pa.array(x[:, k], mask=blank) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weak_label(x).astype(np.int32), mask=blank)], [key, "content", *STATISTICS, "weak"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(work, f"`{key}` {kind}, content long, {', '.join(f'{s} double' for s in STATISTICS)}, weak int")


def evidence_margin(x: np.ndarray) -> np.ndarray:
    """The balance of the evidence, for a corpus that trains no trees."""
    s, p = evidence(x)
    return (s - p).astype(float)


def train(stats: DataFrame, common: CommonWords, *, key: str = "doc_id", sample: int = SAMPLE) -> Boosted:
    """Trees on a bounded sample of weakly labelled rows of ``stats``, calibrated on the hand-checked holdout."""
    from photoloom.llm.holdout import HOLDOUT

    held = statistics([t for _, t in HOLDOUT], common)
    truth = np.array([y for y, _ in HOLDOUT], dtype=float)
    labelled = stats.where((F.col("weak") >= 0) & ~F.col("content").isin([content_hash(t) for _, t in HOLDOUT]))
    # The same share of each kind, taken by hash: the sample's size is bounded, its choice does not depend on the layout.
    totals = {r["weak"]: r["n"] for r in labelled.groupBy("weak").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Boosted(0.0, start=evidence_margin).calibrated(held, truth)
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1_000_000)) / 1e6
    keep = F.lit(False)
    for label, n in totals.items():
        keep = keep | ((F.col("weak") == label) & (spot < 0.9 * sample / 2 / n))
    rows = labelled.where(keep).select(*STATISTICS, "weak").limit(sample).toPandas()
    x, y = rows[STATISTICS].to_numpy(float), rows["weak"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    return fit_boosted(x[order], y[order], trees=100, rate=0.1, share=0.35).calibrated(held, truth)


def text_quality(documents: DataFrame, common_words: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the statistics and the probability that the document is for the most part list, table or junk."""
    words = common_words.where("word IS NOT NULL").select(F.lower("word").alias("word")).distinct()
    if (n := words.count()) > MOST_COMMON:
        raise ValueError(f"{n} common words; a list of more than {MOST_COMMON} is no list of common words")
    common = CommonWords([r["word"] for r in words.collect()])
    stats = cut(text_statistics(documents, common, key=key, text=text))
    model = train(stats, common, key=key)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[STATISTICS].to_numpy(float)
            yield pdf.assign(probability=np.where(np.isnan(x[:, 0]), np.nan, model.probability(np.nan_to_num(x))))

    kinds = dict(stats.dtypes)
    kept = [key, *STATISTICS]
    return stats.select(*kept).mapInPandas(work, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", probability double")


def structure_found(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id of each document that is for the most part a list, a table or junk."""
    return text_quality(documents, common_words).where(F.col("probability") >= CASE).select("doc_id").distinct()
