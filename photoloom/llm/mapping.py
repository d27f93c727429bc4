"""Mapping free-entered values to a canonical list (problem 4): token-level repair, then soft TF-IDF over whole entries.

1. Each *distinct* value is cut into pieces: at anything that is no letter or digit, where a small letter meets a capital, and
   where a word meets a number.  Runs of pieces, written together, are its grams ("HX  9" has "hx9"), up to the length of the longest
   word in the vocabulary and the edits it may have suffered: longer ones cannot match.
2. The vocabulary has the words of all names in the list (canonical names and other names) and runs of neighbouring words
   written together ("lightframe"), and the abbreviations that people make of long words: the first letter and the consonants
   that follow ("bkg" for background).  Distinct grams join it on deletion neighbourhoods (two strings within two
   edits share a string that each becomes by at most two deletions; the strings are joined by their hashes, so a key has one
   size whatever the length of a word), and the exact edit distance, with swaps as one edit, decides.
   Digits are never repaired: a model number is right or it is another model.
3. The best cover of a value by repaired grams gives its corrected tokens; soft TF-IDF cosines rank the names.  A name that has a
   number, none of which the value shows, is out when the value shows another number.  Two entries with equal scores: no entry.

Rows are reduced to distinct values first, and the mapping is joined back by value, so a value that a third of all rows hold
is worked on once.  Nothing is collected to the driver.

Defined results
---------------
* null or blank values and values equal to a canonical name of their field are not mapped (no row).
* a value in which nothing is recognised gets ref_id 0; so does one that fits two entries equally well.
* repeated rows of an image count once (of differing values of one image, the entry of the largest value counts).
* empty tables give an empty result; an empty list maps every value to 0. Values and names may have any length and any number of
  pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photoloom.session import cut

#: Least cosine of a mapping. A single word of a name of three equally telling words has 0.58, one of four has 0.5.
LEAST = 0.52
#: Edits of a word at most.
EDITS = 2
#: Letters of a word that people shorten, and of what they make of it: with fewer letters many short words would be met by chance,
#: and shorter words are not worth shortening.
LONG_WORD, ABBREVIATION = 8, 3
#: What each gram of a cover, and each repaired one, costs in letters: of covers that explain as much, the one of fewer and of
#: exact grams is taken. Both costs are below half a letter, so they never outweigh a letter that is explained.
GRAM_COST, REPAIR_COST = 0.1, 0.3


def pieces(value: str) -> list[str]:
    """The pieces of a hand-typed value, in lower case."""
    v = re.sub(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ])", " ", value)
    v = re.sub(r"(?<=[^\W\d_]{4})(?=\d)|(?<=\d)(?=[^\W\d_]{2})", " ", v)
    return re.findall(r"[^\W_]+", v.lower())


def words(name: str) -> list[str]:
    """The words of a name in the list, hyphens dropped: "HX-16 Pro" is hx16, pro."""
    return [w for w in (re.sub(r"[\W_]", "", w) for w in name.lower().split()) if w]


def deletions(word: str, edits: int = EDITS) -> set[str]:
    """The word and everything it becomes by at most ``edits`` deletions."""
    n = len(word)
    return {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(min(edits, max(n - 1, 0)) + 1) for gone in combinations(range(n), k)}


def edit_distance(a: str, b: str, most: int = EDITS) -> int:
    """Edits from a to b, a swap of neighbours being one; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return min(one[-1], most + 1)


def allowed(word: str) -> int:
    """Edits that a word of this length may have suffered."""
    letters = sum(not c.isdigit() for c in word)
    return 0 if letters < 3 else 1 if letters < 4 else EDITS


def squeeze(word: str) -> str:
    """The word with letters that are repeated on end written once."""
    return re.sub(r"([^\W\d_])\1+", r"\1", word)


def similarity(gram: str, word: str) -> float:
    """1 less half the share of edits; 0 where digits differ or there are more edits than the word allows. A key that hung
    (letters repeated on end) is one edit. Two edits in a word of four letters must leave its first letter alone."""
    if gram == word:
        return 1.0
    if re.sub(r"\D", "", gram) != re.sub(r"\D", "", word):
        return 0.0
    most = allowed(word)
    d = min(edit_distance(gram, word, most), edit_distance(squeeze(gram), squeeze(word), most) + 1)
    if d > most or (len(word) < 5 and d > 1 and gram[0] != word[0]):
        return 0.0
    return 1 - d / len(word) / 2


def _grams(longest: int):
    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f, v in zip(pdf["field_name"], pdf["value"], strict=True):
                p = pieces(v)
                for i in range(len(p)):
                    gram = ""
                    for n, piece in enumerate(p[i:], 1):
                        gram += piece
                        # A key that hung may have stretched a word; written once, its letters must fit.
                        if len(gram) > longest and len(squeeze(gram)) > longest:
                            break
                        out.append((f, v, i, n, gram))
            yield pd.DataFrame(out, columns=["field_name", "value", "start", "run", "gram"])

    return grams


def _keys(name: str):
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f, w in zip(pdf["field_name"], pdf[name], strict=True):
                own = squeeze(w)
                variants = deletions(own, EDITS) | {w}
                if len(w) <= len(own) + 2 * EDITS:
                    variants |= deletions(w, EDITS)
                out += [(f, w, k) for k in {zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in variants}]
            yield pd.DataFrame(out, columns=["field_name", name, "key"])

    return keys


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.assign(sim=[similarity(g, w) for g, w in zip(pdf["gram"], pdf["word"], strict=True)])
        yield pdf[pdf["sim"] > 0]


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best cover of each value: repaired grams that do not overlap, with most letters explained."""
    for pdf in batches:
        out = []
        for f, v, found in zip(pdf["field_name"], pdf["value"], pdf["found"], strict=True):
            p = pieces(v)
            at: dict[int, list] = {}
            for x in found:
                at.setdefault(x["start"], []).append((x["run"], x["sim"], x["word"], x["parts"]))
            best: list[tuple[float, list]] = [(0.0, [])] * (len(p) + 1)
            for i in range(len(p) - 1, -1, -1):
                best[i] = best[i + 1]
                for n, sim, word, parts in sorted(at.get(i, []), key=lambda x: (x[0], -x[1], x[2])):
                    gain = sim * sum(map(len, p[i : i + n])) - GRAM_COST - REPAIR_COST * (sim < 1)
                    if gain + best[i + n][0] > best[i][0] + 1e-9:
                        best[i] = (gain + best[i + n][0], [(i, n, sim, parts), *best[i + n][1]])
            taken = {k for i, n, _, _ in best[0][1] for k in range(i, i + n)}
            odd = any(any(c.isdigit() for c in w) for k, w in enumerate(p) if k not in taken)
            # All repairs of the grams in the cover stay in play: which one is meant, the whole entry decides.
            for i, n, _, chosen in best[0][1]:
                for m, sim, _, parts in at[i]:
                    if m == n and parts.count(" ") == chosen.count(" "):
                        out += [(f, v, f"{i}.{k}", t, sim, odd) for k, t in enumerate(parts.split(" "))]
        yield pd.DataFrame(out, columns=["field_name", "value", "spot", "token", "sim", "odd_number"])


def names_of(ref_values: DataFrame) -> DataFrame:
    """field_name, ref_id, name, words: canonical and other names."""
    names = F.array_union(F.array("canonical"), F.split(F.coalesce("also_known_as", F.lit("")), r"\s*;\s*"))
    split = F.filter(F.transform(F.split(F.lower(F.trim("name")), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")
    return ref_values.select("field_name", "ref_id", F.explode(names).alias("name")).where("trim(name) <> ''").distinct().withColumn("words", split)


def vocabulary(names: DataFrame) -> DataFrame:
    """field_name, word, parts: the words of names and runs of neighbouring words written together, each word in full or, in a
    run of its own spelling, abbreviated."""
    bones = lambda w: F.concat(F.substring(w, 1, 1), F.regexp_replace(F.regexp_replace(F.substr(w, F.lit(2)), "ck", "k"), "[aeiouyäöü]", ""))
    short = F.transform("words", lambda w: F.when((F.length(w) >= LONG_WORD) & ~w.rlike(r"\d"), F.substring(bones(w), 1, ABBREVIATION)).otherwise(w))
    spelled = names.where(F.size("words") > 0).select("field_name", "words", F.explode(F.array_distinct(F.array(F.col("words"), short))).alias("as"))

    def runs(name: str) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.size("words") - i), lambda n: F.slice(name, i + 1, n))))

    both = spelled.select("field_name", F.inline(F.arrays_zip(runs("as").alias("w"), runs("words").alias("p"))))
    return both.groupBy("field_name", F.array_join("w", "").alias("word")).agg(F.min(F.array_join("p", " ")).alias("parts"))


def map_values(values: DataFrame, ref_values: DataFrame) -> DataFrame:
    """field_name, value, ref_id, score for each distinct (field_name, value)."""
    names = names_of(ref_values)
    vocab = cut(vocabulary(names))
    longest = (vocab.agg(F.max(F.length("word"))).first()[0] or 0) + EDITS
    values = values.select("field_name", "value").distinct()
    grams = cut(values.mapInPandas(_grams(longest), "field_name string, value string, start int, run int, gram string"))
    left = grams.select("field_name", "gram").distinct().mapInPandas(_keys("gram"), "field_name string, gram string, key long")
    right = vocab.select("field_name", "word").mapInPandas(_keys("word"), "field_name string, word string, key long")
    near = left.join(right, ["field_name", "key"]).select("field_name", "gram", "word").distinct()
    repairs = near.mapInPandas(_similar, "field_name string, gram string, word string, sim double").join(vocab, ["field_name", "word"])
    found = grams.join(repairs, ["field_name", "gram"]).groupBy("field_name", "value").agg(F.collect_list(F.struct("start", "run", "sim", "word", "parts")).alias("found"))
    tokens = cut(found.mapInPandas(_cover, "field_name string, value string, spot string, token string, sim double, odd_number boolean"))
    # Weights: a word is the more telling, the fewer entries of its field have it in one of their names.
    entry_words = names.select("field_name", "ref_id", "name", F.explode(F.array_distinct("words")).alias("token"))
    entries = names.groupBy("field_name").agg(F.countDistinct("ref_id").alias("n"))
    weight = entry_words.groupBy("field_name", "token").agg(F.countDistinct("ref_id").alias("df")).join(entries, "field_name").select("field_name", "token", F.log1p(F.col("n") / F.col("df")).alias("idf"))
    has_number = F.exists("words", lambda w: w.rlike(r"\d"))
    norms = entry_words.join(weight, ["field_name", "token"]).groupBy("field_name", "name").agg(F.sqrt(F.sum(F.pow("idf", F.lit(2)))).alias("name_norm"))
    postings = entry_words.join(weight, ["field_name", "token"]).join(norms, ["field_name", "name"]).join(names.select("field_name", "ref_id", "name", has_number.alias("numbered")), ["field_name", "ref_id", "name"])
    t = tokens.join(postings, ["field_name", "token"])
    square = lambda c: F.pow(c, F.lit(2))
    by_spot = tokens.join(weight, ["field_name", "token"]).groupBy("field_name", "value", "spot").agg(F.max_by(square("idf"), F.struct("sim", "idf")).alias("w"))
    value_norm = by_spot.groupBy("field_name", "value").agg(F.sqrt(F.sum("w")).alias("value_norm"))
    name = ["field_name", "value", "ref_id", "name", "name_norm", "numbered", "odd_number"]
    met = t.groupBy(*name, "spot").agg(F.max(square("idf") * F.col("sim")).alias("dot"), F.max(F.col("token").rlike(r"\d")).alias("number_met"))
    scores = met.groupBy(*name).agg(F.sum("dot").alias("dot"), F.max("number_met").alias("number_met"))
    scores = scores.where(~(F.col("numbered") & F.col("odd_number") & ~F.col("number_met"))).join(value_norm, ["field_name", "value"])
    best = scores.groupBy("field_name", "value", "ref_id").agg(F.max(F.col("dot") / F.col("name_norm") / F.col("value_norm")).alias("score"))
    by_value = W.partitionBy("field_name", "value").orderBy(F.desc("score"), "ref_id")
    ranked = best.withColumns({"place": F.row_number().over(by_value), "next": F.lead("score").over(by_value)}).where("place = 1")
    clear = (F.col("score") >= LEAST) & (F.coalesce("next", F.lit(0.0)) < F.col("score") - 1e-6)
    mapped = ranked.where(clear).select("field_name", "value", "ref_id", "score")
    return values.join(mapped, ["field_name", "value"], "left").select("field_name", "value", F.coalesce("ref_id", F.lit(0)).alias("ref_id"), "score")


def typed_values(frames: DataFrame, ref_values: DataFrame, fields: tuple[str, ...] = ("imagetyp", "instrume")) -> DataFrame:
    """image_id, field_name, value of every value that is neither null, blank nor canonical."""
    long = frames.select("image_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))))
    canonical = ref_values.select("field_name", F.col("canonical").alias("value")).distinct()
    return long.where(F.col("image_id").isNotNull() & F.regexp_like("value", F.lit(r"[^\s\p{Z}]"))).join(canonical, ["field_name", "value"], "left_anti")


def mapped_found(frames: DataFrame, ref_values: DataFrame) -> DataFrame:
    """image_id, field_name, ref_id: what each typed value means, 0 for no entry."""
    typed = typed_values(frames, ref_values)
    rows = typed.join(map_values(typed, ref_values), ["field_name", "value"])
    return rows.groupBy("image_id", "field_name").agg(F.max_by("ref_id", "value").cast("int").alias("ref_id"))
