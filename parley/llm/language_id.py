"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams in order of rank, counted over all its training texts. A
document gets a list of its own, and its distance to a language adds up how far each of its n-grams is out of
place in the language's list; an n-gram that the list lacks counts as the length of the list. The language with
the least distance wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm._shared import id_remainder

#: n-grams in a profile and in a document's list; their greatest length (21 bits for each character in a long).
PROFILE, LONGEST, BITS = 400, 3, 21
#: What stands for a run of other characters: no letter, and not 0, which would leave a code as it is at its front.
BOUNDARY = 1
#: Characters whose n-grams are counted at once in training.
CHUNK = 1 << 21
UNDETERMINED = "und"


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of the text's lower-case letters; a run of other characters is one boundary."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where(_letter_table()[points], points, BOUNDARY)
    points = np.concatenate(([BOUNDARY], points, [BOUNDARY]))
    letter = points != BOUNDARY
    points = points[np.concatenate(([True], letter[1:] | letter[:-1]))]
    letter = points != BOUNDARY
    found, code = [points[letter]], points
    for n in range(2, LONGEST + 1):
        code = (code[:-1] << BITS) | points[n - 1 :]
        inner = np.ones(len(code), bool)
        for k in range(1, n - 1):  # no boundary inside
            inner &= letter[k : len(points) - n + 1 + k]
        found.append(code[inner] if n > 2 else code)
    return np.concatenate(found) if len(points) > 1 else np.zeros(0, np.int64)


def ranked(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The distinct codes, the most frequent first and the smaller code first among equals."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.lexsort((values, -counts))[:most]]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            held, size = [], 0
            for k, text in enumerate(texts, 1):
                held.append(grams(text))
                size += len(held[-1])
                if size > CHUNK or k == len(texts):
                    values, counts = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": values, "n": counts})
                    held, size = [], 0


def train_profiles(texts: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's n-grams by rank, counted over all rows of ``texts`` (columns ``text``, ``lang``).

    Null languages and texts are left out. What reaches the driver is ``profile`` codes for each language.
    """
    known = texts.where("lang is not null and text is not null").select("text", "lang")
    counts = known.mapInPandas(_counts, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    found = best.select("lang", "rank", "gram").toPandas().sort_values(["lang", "rank"])
    return {lang: rows["gram"].to_numpy(np.int64) for lang, rows in found.groupby("lang")}


class Profiles:
    """The profiles as sorted arrays, to look up a document's n-grams."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.tables = []
        for lang in self.langs:
            by_code = np.argsort(profiles[lang])
            self.tables.append((profiles[lang][by_code], by_code))
        self.missing = max((len(codes) for codes, _ in self.tables), default=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(grams(text), self.missing)
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        places, distances = np.arange(len(own)), []
        for codes, ranks in self.tables:
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            away = np.where(codes[at] == own, np.abs(ranks[at] - places), self.missing)
            distances.append(int(away.sum()))
        best = int(np.argmin(distances))
        return self.langs[best], 1 - distances[best] / (self.missing * len(own))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text") -> Column:
    """A struct of ``lang_pred`` and ``score`` for ``text_col``; only the text is read."""
    table = Profiles(profiles)

    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([table.predict(x) for x in texts], columns=["lang_pred", "score"])

    return F.pandas_udf(of, "lang_pred string, score double")(docs[text_col])


def held_out(doc_id: Column) -> Column:
    """Documents that training does not see."""
    return id_remainder(doc_id, 4) == 2


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every row of ``docs``.

    Profiles are learned from ``text`` and the non-null ``lang`` of the rows that are not held out. ``score`` is
    1 less the distance to the best profile as a share of the largest possible one. Null texts and texts without
    a letter are ``und`` with score 0, as is everything when no row can be learned from. Ties between languages go
    to the first by name. Repeated rows get equal results; an empty table gives no rows.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col("lang").cast("string").alias("lang"))
    profiles = train_profiles(text.where(~held_out(F.col("doc_id"))))
    found = text.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(text, profiles).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all their columns as they are."""
    profiles = train_profiles(
        docs.where(~held_out(docs[id_col])).select(docs[text_col].alias("text"), docs["lang"].cast("string").alias("lang"))
    )
    return docs.where(identify(docs, profiles, text_col)["lang_pred"] != UNDETERMINED)
