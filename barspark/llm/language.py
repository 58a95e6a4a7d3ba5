"""Language identification by rank-order n-gram profiles (out-of-place distance).

A text is the lower-case code points of its letters and combining marks, with one border for
each run of anything else. An n-gram of 1 to 3 of them is their code points side by side in one
63-bit number, so those of every script are told apart exactly. A profile is the TOP most
frequent n-grams in rank order; a language's profile comes from the counts of all its training
texts, summed by Spark. The model has TOP numbers a language, which is what reaches the driver
and goes to the tasks, as a sorted list of (n-gram, language, rank); no table of n-grams times
languages is made. A text gets the language whose profile its own most frequent n-grams are
least out of place in: the sum of rank differences, TOP for one that is missing.

Defined cases: a null text or one without a letter is "und" with score 0; ties go to the
language first in order; without training rows all is "und"; rows with equal or null ids
are rows of their own; texts are used whole; other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import columns
from .support import saved

#: Bits of a symbol in the number of an n-gram.
BITS = 21
TOP = 300
#: N-grams that a training task holds before it passes them on.
HELD = 1 << 20
UNKNOWN = "und"


@lru_cache(1)
def symbols() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point (1 a border, else the lower-case code point and 1), and whether it is a letter."""
    out, letter = np.ones(0x110000, np.int64), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            low = c.lower()
            out[cp] = 1 + (ord(low) if len(low) == 1 else cp)
            letter[cp] = kind == "L"
    return out, letter


def grams(text: str) -> np.ndarray | None:
    """The number of each n-gram, once for each time it occurs; None without letters. A border alone is none."""
    symbol, letter = symbols()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not letter[points].any():
        return None
    s = symbol[points]
    keep = s > 1
    keep[1:] |= s[:-1] > 1  # the first of a run of others stays as the border
    s = np.concatenate([[1], s[keep], [1]])
    if s[-2] == 1:
        s = s[:-1]
    pairs = s[:-1] << BITS | s[1:]
    return np.concatenate([s[s > 1], pairs, pairs[:-1] << BITS | s[2:]])


def ranked(found: np.ndarray) -> np.ndarray:
    """The TOP most frequent n-grams, ties by number."""
    some, count = np.unique(found, return_counts=True)
    return some[np.argsort(-count, kind="stable")[:TOP]]


def _texts(column):
    data, offsets = columns.buffers(column)
    for i, j in columns.slices(offsets):
        raw = data[offsets[i] : offsets[j]].tobytes()
        at = (offsets[i : j + 1] - offsets[i]).tolist()
        yield i, j, [raw[a:b].decode() for a, b in zip(at[:-1], at[1:])]


def _count_by_language(batches):
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i, _, texts in _texts(batch.column(1)):
            new: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(langs[i:], texts):
                found = grams(text)
                if found is not None:
                    new.setdefault(lang, []).append(found)
            for lang, found in new.items():
                sums[lang] = _added(sums.get(lang), *np.unique(np.concatenate(found), return_counts=True))
            if sum(len(codes) for codes, _ in sums.values()) > HELD:  # memory stays bounded; counts add up later
                yield from _emit(sums)
                sums = {}
    yield from _emit(sums)


def _added(sums, codes, count):
    if sums is None:
        return codes, count
    both, at = np.unique(np.concatenate([sums[0], codes]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([sums[1], count])).astype(np.int64)


def _emit(sums):
    for lang, (codes, count) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes, pa.int64()), pa.array(count, pa.int64())], names=["lang", "code", "n"])


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Each language's profile, from all rows whose lang_col and text are not null."""
    ship(df.sparkSession)
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = rows.mapInArrow(_count_by_language, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    sums = saved(sums, "language-counts")
    # Each of 16 parts of a language gives its TOP, and of these few the language its own.
    part, whole = W.partitionBy("lang", F.pmod("code", F.lit(16))).orderBy(F.desc("n"), "code"), W.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = sums.withColumn("r", F.row_number().over(part)).where(F.col("r") <= TOP)
    best = best.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= TOP).select("lang", "code", "n").toPandas()
    model = {}
    for lang, g in best.groupby("lang"):
        model[lang] = g.sort_values(["n", "code"], ascending=[False, True])["code"].to_numpy()[:TOP]
    return dict(sorted(model.items()))


class Judge:
    """Profiles as one list of (n-gram, language, rank), sorted by n-gram."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.langs = list(model)
        codes = np.concatenate([np.empty(0, np.int64), *model.values()])
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.lang = np.repeat(np.arange(len(model)), [len(c) for c in model.values()])[order]
        self.rank = np.concatenate([np.empty(0, np.int64), *(np.arange(len(c)) for c in model.values())])[order]

    def __call__(self, text: str) -> tuple[str, float]:
        """The language, and by how much of the worst distance its profile is nearer than that: 0 to 1."""
        found = grams(text) if self.langs else None
        if found is None:
            return UNKNOWN, 0.0
        own = ranked(found)
        first = np.searchsorted(self.codes, own, "left")
        many = np.searchsorted(self.codes, own, "right") - first
        place = np.repeat(np.arange(len(own)), many)
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(place))
        nearer = np.bincount(self.lang[at], TOP - np.abs(self.rank[at] - place), len(self.langs))
        best = int(nearer.argmax())
        return self.langs[best], float(nearer[best]) / (TOP * len(own))


def predict(df: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", passing: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """passing columns, and the language and its score under the given names. The model (TOP codes a language) goes along with the tasks."""
    ship(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in passing), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    read = [*passing, *([] if text_col in passing else [text_col])]
    at = read.index(text_col)

    def run(batches):
        judge = Judge(model)
        for batch in batches:
            for i, j, texts in _texts(batch.column(at)):
                found = [judge(t) for t in texts]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(passing)]), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """True for the fifth of ids that no training sees."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0
