"""Rules that read one text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import lexicon as words


def one_of(value: Column, allowed: list[str]) -> Column:
    return value.isin(*allowed)


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether a text contains one of the phrases, as they are written."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and apostrophes, the apostrophes removed."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z']+"), 0)
    return F.transform(found, lambda t: F.replace(F.lower(t), F.lit("'"), F.lit("")))


def lexical_polarity(tokens_: Column) -> Column:
    """``positive`` or ``negative`` by more words of that kind, null on a tie.

    A word counts for the other side if one of the three tokens before it is a negation.
    """
    negations = F.array(*map(F.lit, words.NEGATIONS))

    def vote(token: Column, at: Column) -> Column:
        start = F.greatest(at - 3, F.lit(0))
        turned = F.arrays_overlap(F.slice(tokens_, start + 1, at - start), negations)
        # the tokens before are looked at for the few that have a side
        side = lambda kind: F.when(turned, -kind).otherwise(kind)
        found = F.when(one_of(token, words.NEGATIONS), 0).when(one_of(token, words.POSITIVE_WORDS), side(1))
        return found.when(one_of(token, words.NEGATIVE_WORDS), side(-1)).otherwise(0)

    total = F.aggregate(F.transform(tokens_, vote), F.lit(0), lambda a, b: a + b)
    return F.when(total > 0, "positive").when(total < 0, "negative")


def stance(tokens_: Column) -> Column:
    """``affirm`` or ``deny``; denial wins, and null if neither is said."""
    padded = F.concat(F.lit(" "), F.array_join(tokens_, " "), F.lit(" "))
    says = lambda phrases: contains_any(padded, [f" {p} " for p in phrases])
    return F.when(says(words.DENIALS), "deny").when(says(words.AFFIRMATIONS), "affirm")


def emotion_polarity(emotion: Column) -> Column:
    """Calm counts as positive."""
    lower = F.lower(emotion)
    return (
        F.when(one_of(lower, words.NEGATIVE_EMOTIONS), "negative")
        .when(one_of(lower, words.POSITIVE_EMOTIONS), "positive")
        .when(one_of(lower, words.NEUTRAL_EMOTIONS), "neutral")
    )
