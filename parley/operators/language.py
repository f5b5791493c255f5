"""Rules that label one text: cleaning, gating of given labels, emotion, intent, cues, candidates and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import contains_any
from parley.operators.metrics import ratio, word_count

# Emotions and the words that name them, in the order in which they are tried.
EMOTION_WORDS = [
    ("angry", ["angry", "mad", "furious", "crap", "stupid", "idiot"]),
    ("sad", ["sorry", "sad", "upset", "bad news"]),
    ("happy", ["great", "awesome", "amazing", "nice holiday", "happy"]),
]
BASIC_EMOTIONS = ["neutral", "happy", "sad", "angry", "fear"]
# Intents and their phrases, in the order in which they are tried after greetings and questions.
GREETINGS = ["hi", "hello", "hey"]
QUESTION_PHRASES = ["?", "could you", "would you", "can you"]
INTENT_PHRASES = [
    ("apology", ["sorry", "apologize", "my fault"]),
    ("complaint", ["angry", "mad", "upset", "frustrated", "terrible", "horrible"]),
    ("storytelling", ["story", "when i was", "i remember", "i tell you", "basically what this is about"]),
    ("gratitude", ["thanks", "thank you", "appreciate it"]),
    ("agreement", ["okay", "ok", "that works", "sounds good"]),
    ("closing", ["bye", "goodbye", "talk to you later"]),
]
# Cues of hesitation, aggression, certainty and hedging.
HESITATION = ["um", "uh", "you know", "er", "ah", "kind of", "sort of", "..."]
AGGRESSION = ["crap", "stupid", "idiot", "hate", "dumb", "aggressive", "angry"]
CERTAINTY = ["always", "never", "impossible", "absolutely", "definitely"]
HEDGES = ["i think", "maybe", "probably", "i guess"]
# Patterns of links and numbers.
LINK, NUMBER = r"(?i)\bhttps?://[^\s]+", r"\b\d+\b"
#: Characters of a text that topic and sentiment labels, summaries and claims are made from.
LABELLED_CHARS, SUMMARY_CHARS, CLAIM_CHARS = 512, 4_000, 10_000


def clean_text(text: Column) -> Column:
    """Text as sentiment labels expect it. The slash goes before links are looked for, so few are found."""
    text = F.trim(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, r"[^A-Za-z0-9\s.,!?;:'\"-]", " ")
    text = F.regexp_replace(text, r"https?://\S+|www\.\S+", "")
    text = F.regexp_replace(text, r"(.)\1{2,}", "$1$1")
    text = F.regexp_replace(text, r"(?i)\b(uh|um|hmm|erm|ahh|mm)\b", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def gated_sentiment(text: Column, label: Column, score: Column) -> tuple[Column, Column]:
    """A given label and score, neutral where the score is too low for the text's length."""
    clean = clean_text(text)
    lower = F.lower(label)
    mapped = F.when(lower.contains("pos"), "positive").when(lower.contains("neg"), "negative").otherwise("neutral")
    least = F.when(word_count(clean) < 4, 0.80).when(mapped == "neutral", 0.50).otherwise(0.65)
    empty = (clean == "") | label.isNull() | score.isNull()
    kept = F.when(empty | (score < least), "neutral").otherwise(mapped)
    return kept, F.when(empty, 0.0).otherwise(score)


def emotion_of(text: Column, sentiment: Column) -> Column:
    """The first emotion that the text names, else the one that goes with the sentiment."""
    lower, found = F.lower(F.coalesce(text, F.lit(""))), F
    for emotion, phrases in EMOTION_WORDS:
        found = found.when(contains_any(lower, phrases), emotion)
    mood = F.lower(sentiment)
    return found.when(mood == "positive", "happy").when(mood == "negative", "sad").otherwise("neutral")


def emotion_scores(emotion: Column) -> Column:
    """1 for the emotion, 0 for the other basic ones."""
    pairs = [x for e in BASIC_EMOTIONS for x in (F.lit(e), (emotion == e).cast("double"))]
    return F.create_map(*pairs)


def intent_of(text: Column) -> Column:
    lower = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    greets = F.lit(False)
    for word in GREETINGS:
        greets = greets | lower.startswith(word)
    found = F.when(lower == "", "other").when(greets, "greeting").when(contains_any(lower, QUESTION_PHRASES), "question")
    for intent, phrases in INTENT_PHRASES:
        found = found.when(contains_any(lower, phrases), intent)
    return found.when(word_count(lower) > 5, "information_sharing").otherwise("other")


def intent_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id", intent_of(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


def cues(turns: DataFrame) -> DataFrame:
    """A row per turn and cue: hesitation, aggression, and certainty mixed with hedging."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    cue = lambda kind, score: F.struct(F.lit(kind).alias("type"), F.lit(score).alias("score"))
    found = F.array(
        F.when(contains_any(lower, HESITATION), cue("hesitation", 0.6)),
        F.when(contains_any(lower, AGGRESSION), cue("aggression", 0.7)),
        F.when(contains_any(lower, CERTAINTY) & contains_any(lower, HEDGES), cue("lie_risk", 0.5)),
    )
    rows = turns.select("session_id", "utt_id", "speaker", F.explode(F.array_compact(found)).alias("cue"))
    return rows.select("session_id", "utt_id", "speaker", "cue.type", "cue.score")


def candidates(turns: DataFrame) -> DataFrame:
    """Links and numbers to verify, in their order, all links of a text first."""
    text = F.coalesce("text", F.lit(""))
    of = lambda pattern, kind: F.transform(
        F.regexp_extract_all(text, F.lit(pattern), 0), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    )
    rows = turns.select("session_id", "utt_id", F.posexplode(F.concat(of(LINK, "url"), of(NUMBER, "number"))).alias("at", "c"))
    return rows.select("session_id", "utt_id", F.col("at").cast("long").alias("place"), "c.type", "c.value", F.lit("TO_VERIFY").alias("status"))


def sentiment_shares(turns: DataFrame) -> DataFrame:
    """Share of each label among the labelled turns of a session."""
    counts = turns.where("sent_label is not null").groupBy("session_id", "sent_label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("session_id"))))


def emotion_shares(turns: DataFrame) -> DataFrame:
    """Share of each basic emotion among a speaker's turns."""
    named = turns.withColumn("emotion_name", emotion_of(F.col("text"), F.col("sent_label")))
    counts = named.groupBy("session_id", "speaker").pivot("emotion_name", BASIC_EMOTIONS).count().na.fill(0)
    total = sum((F.col(e) for e in BASIC_EMOTIONS), F.lit(0))
    return counts.select("session_id", "speaker", *[ratio(F.col(e), total).alias(e) for e in BASIC_EMOTIONS])


def best_label(scores: Column, text: Column) -> Column:
    """Name and value of the highest entry of a map, the first among equals; unknown for a blank text."""
    entries = F.map_entries(scores)
    top = F.array_max(F.transform(entries, lambda e: e["value"]))
    best = F.get(F.filter(entries, lambda e: e["value"] == top), F.lit(0))
    unknown = F.coalesce(F.trim(text) == "", F.lit(True)) | best.isNull()
    return F.struct(
        F.when(unknown, "unknown").otherwise(best["key"]).alias("topic"),
        F.when(unknown, 0.0).otherwise(best["value"]).alias("confidence"),
    )


def term_weights(turns: DataFrame) -> DataFrame:
    """Count of each term (two word characters at least) of a turn, divided by the length of the count vector."""
    terms = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\b\w\w+\b"), 0)
    rows = turns.select("session_id", "utt_id", F.explode(terms).alias("term"))
    counts = rows.groupBy("session_id", "utt_id", "term").agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("session_id", "utt_id")))
    return counts.withColumn("weight", F.round(F.col("n") / length, 6))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_keywords(turns: DataFrame, k: int = 5, similarity: DataFrame | None = None) -> DataFrame:
    """The ``k`` heaviest terms of each turn; ``similarity`` (utt_id, term, similarity) adds to the weight."""
    rows = term_weights(turns)
    if similarity is not None:
        rows = rows.join(similarity, ["utt_id", "term"], "left")
        rows = rows.withColumn("weight", F.col("weight") + F.coalesce("similarity", F.lit(0.0))).drop("similarity")
    order = Window.partitionBy("session_id", "utt_id").orderBy(F.desc("weight"), "term")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def break_long_words(text: Column, at: int = 40) -> Column:
    """A space after every ``at`` characters of a word that goes on."""
    return F.regexp_replace(text, rf"(\S{{{at}}})(?=\S)", "$1 ")
