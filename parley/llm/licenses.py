"""Licence scans by a positional rare-token index.

Templates are short word sequences that name a licence. The index posts each template under the two rarest of its
mandatory words (highest inverse document frequency over the corpus), with their places in the template. A file's
words fetch the postings of the rarest; they are intersected with those of the second rarest by relative position.
Where both stand, the mandatory key phrase must stand word for word; the share of the template's other words found in
place is its score. A file's licence words are in order, so a template is compared with those around its rarest word
only, and the work grows with the length of the text.

Everything is DataFrame expressions. One pass over the texts keeps each file's licence words with their places;
the rest works on that small table, row by row. Only the document frequencies of the template words are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm._shared import ANY_CASE_WORD, UPPER, materialize


@dataclass(frozen=True)
class Template:
    """``words`` in lower case; those from ``key_from`` to before ``key_to`` are the mandatory key phrase."""

    label: str
    words: str
    key: str

    @property
    def tokens(self) -> list[str]:
        return self.words.split()

    @property
    def key_from(self) -> int:
        n = len(self.key.split())
        return next(i for i in range(len(self.tokens)) if self.tokens[i : i + n] == self.key.split())


#: The phrases whose places are reported, with their labels.
BASE = (
    Template("mit", "under the mit license", "under the mit license"),
    Template("apache-2", "apache license version 2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
)
#: Further licence notices, found if their key phrase stands and enough of the rest does.
MORE = (
    Template("mit", "the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    Template("mit", "spdx license identifier mit", "license identifier mit"),
    Template("apache-2", "spdx license identifier apache 2 0", "license identifier apache 2"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "spdx license identifier gpl 3 0", "license identifier gpl 3"),
    Template("agpl-3", "gnu affero general public license version 3", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license version", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("isc", "released under the isc license", "isc license"),
    Template("mpl-2", "mozilla public license version 2 0", "mozilla public license version 2"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    Template("cc-by-nc", "creative commons attribution noncommercial", "commons attribution noncommercial"),
    Template("cc0", "creative commons zero universal public domain dedication", "public domain dedication"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
)
#: Share of a template's words that must stand in place.
ENOUGH = 0.5


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple[Template, ...] = BASE,
    more: tuple[Template, ...] = MORE,
    enough: float = ENOUGH,
) -> DataFrame:
    """The licence notices of every row of ``docs``.

    Columns: ``doc_id``; ``n_words``; ``n_base`` (places of base phrases); ``first_word`` and ``last_word`` (the
    smallest and largest of them, in words from 0, else null); ``base_labels`` and ``labels`` (distinct, sorted,
    comma-joined, else empty); ``score`` (the largest share of a found template's words in place, else 0);
    ``places`` (label, start word and share of every notice found). Null text counts as empty. Repeated rows get
    equal results; an empty table gives no rows. Very long texts of notices take time in proportion to their length.
    Keys have two words at least. Only the two named columns are read.
    """
    templates = [*base, *more]
    vocabulary = sorted({word for t in templates for word in t.tokens})
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(ANY_CASE_WORD), 0)
    words = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    at = F.transform("words", lambda w, i: F.struct(F.translate(w, UPPER, UPPER.lower()).alias("w"), i.alias("i")))
    found = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.filter(at, lambda x: x["w"].isin(vocabulary)).alias("hits"),
    )
    found = materialize(found, "licence-words")

    # inverse document frequency decides under which mandatory word a template is posted
    frequency = found.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w"))
    frequency = {r["w"]: r["count"] for r in frequency.groupBy("w").count().collect()}  # one row a template word
    postings: dict[str, list[tuple[int, int, int]]] = {}
    for number, t in enumerate(templates):
        places = range(t.key_from, t.key_from + len(t.key.split()))
        first, second = sorted(places, key=lambda k: (frequency.get(t.tokens[k], 0), k))[:2]
        postings.setdefault(t.tokens[first], []).append((number, first, second))

    index = F.array(
        *[
            F.struct(
                F.lit(w).alias("w"), F.lit(number).alias("t"), F.lit(first).alias("at"), F.lit(templates[number].tokens[second]).alias("w2"), F.lit(second).alias("at2")
            )
            for w, posted in sorted(postings.items())
            for number, first, second in posted
        ]
    )
    known = F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"),
                F.array(*map(F.lit, t.tokens)).alias("words"),
                F.lit(t.key_from).alias("key_from"),
                F.lit(len(t.key.split())).alias("key_n"),
                F.lit(number < len(base)).alias("base"),
            )
            for number, t in enumerate(templates)
        ]
    )

    reach = max(len(t.tokens) for t in templates)

    def starts(hits: Column) -> Column:
        """Template, start and the words around it for every posting of a word whose second posting stands in place."""
        numbered = F.transform(hits, lambda h, k: F.struct(h["w"].alias("w"), h["i"].alias("i"), k.alias("k")))
        rare = F.filter(numbered, lambda h: h["w"].isin(sorted(postings)))

        def fetched(h: Column) -> Column:
            first = F.greatest(F.lit(0), h["k"] - reach)
            near = F.slice(hits, first + 1, h["k"] - first + reach)
            posted = F.filter(
                F.filter(index, lambda p: p["w"] == h["w"]),
                lambda p: F.exists(near, lambda o: (o["w"] == p["w2"]) & (o["i"] - h["i"] == p["at2"] - p["at"])),
            )
            return F.transform(posted, lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["at"]).alias("start"), near.alias("near")))

        return F.flatten(F.transform(rare, fetched))

    def around(hits: Column, start: Column, length: Column) -> Column:
        return F.filter(hits, lambda h: (h["i"] >= start) & (h["i"] < start + length))

    def checked(candidate: Column) -> Column:
        """The candidate with its template and the places of the template that hold the right word."""
        t = F.element_at(known, candidate["t"] + 1)
        near = around(candidate["near"], candidate["start"], F.size(t["words"]))
        in_place = F.filter(near, lambda h: h["w"] == F.element_at(t["words"], h["i"] - candidate["start"] + 1))
        of_key = F.filter(
            in_place,
            lambda h: (h["i"] - candidate["start"] >= t["key_from"])
            & (h["i"] - candidate["start"] < t["key_from"] + t["key_n"]),
        )
        return F.struct(
            t["label"].alias("label"),
            t["base"].alias("base"),
            candidate["start"].cast("long").alias("start"),
            (F.size(in_place) / F.size(t["words"])).alias("share"),
            (F.size(of_key) == t["key_n"]).alias("key"),
        )

    verified = F.filter(
        F.transform(starts(F.col("hits")), checked), lambda c: c["key"] & (c["share"] >= enough)
    )
    rows = found.select("doc_id", "n_words", verified.alias("found"))
    of_base = F.filter("found", lambda c: c["base"])

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda c: c["label"]))), ",")

    return rows.select(
        "doc_id",
        "n_words",
        F.size(of_base).cast("long").alias("n_base"),
        F.array_min(F.transform(of_base, lambda c: c["start"])).alias("first_word"),
        F.array_max(F.transform(of_base, lambda c: c["start"])).alias("last_word"),
        labels(of_base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda c: c["share"])), F.lit(0.0)).alias("score"),
        F.transform("found", lambda c: F.struct(c["label"].alias("label"), c["start"].alias("start"), c["share"].alias("share"))).alias("places"),
    )
