"""The given tables as tables of conversations.

``events`` become utterances: a user's events are one session, an hour becomes a second, and the text is one of
a few template sentences, so that every rule that reads text has something to read. Times are whole milliseconds
and scores whole ten-thousandths, which keeps sums exact whatever the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ``{v}`` stands for the event's value, cut to a whole number.
TEMPLATES = [
    "Hello, thank you for calling, how can I help you today?",
    "Yes, of course, that is correct.",
    "No, I disagree, that is wrong.",
    "This is terrible, the app is broken and I am furious.",
    "I am not happy with the useless support.",
    "That was great, I really appreciate the helpful answer.",
    "Please send the report to Maria by Friday at 3 pm.",
    "Let's schedule a follow-up call next Tuesday for 30 minutes.",
    "Can you email me the invoice details?",
    "I want to speak to a manager, this is unacceptable!",
    "Bitcoin is at {v} dollars.",
    "The temperature in Paris is {v} C today.",
    "Gold costs {v} dollars per ounce today.",
    "Um, maybe, I guess it was fine, er, I think so.",
    "See https://example.com/help?id={v} for details, case 42.",
    "I never said that, to be honest I don't remember.",
    "Absolutely, we definitely agree on the price of {v}.",
    "What time does the office open on Monday?",
    "It is not a problem, no issue at all.",
    "Bye, have a nice day.",
    "The capital of France is Paris.",
    "USD to EUR is {v} right now.",
    "We need to fix this urgently, John will handle the upload tomorrow.",
    "I feel sad and upset about the awful delay.",
]

#: Emotion maps of two entries; the numbers are whole hundredths.
EMOTIONS = [
    ("angry", 70, "calm", 30),
    ("happy", 60, "calm", 40),
    ("frustrated", 55, "neutral", 45),
    ("neutral", 80, "calm", 20),
    ("sad", 50, "fear", 50),
    ("calm", 65, "happy", 35),
    ("Joy", 90, "neutral", 10),
    ("upset", 40, "anxious", 60),
]


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _choose(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of the clock that ``ts`` shows, whatever the session's time zone."""
    second = F.floor(F.extract(F.lit("SECOND"), ts) * 1000)
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400_000 + (F.hour(ts) * 60 + F.minute(ts)) * 60_000 + second


def utterances_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event, in the columns that the operators take."""
    events = read_table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    mine = Window.partitionBy("session_id")  # by the name that later rules group by, so that they need no second exchange
    ms = epoch_ms(F.col("ts"))
    score = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 101) * 100)
    label = F.when(score < 3500, "negative").when(score > 6500, "positive").when(score.isNotNull(), "neutral")
    start = F.expr("cast(floor((ms - first_ms) / 3600) as bigint)")
    emotion = F.map_from_arrays(
        F.array(_choose([e[0] for e in EMOTIONS], F.col("k")), _choose([e[2] for e in EMOTIONS], F.col("k"))),
        F.array(
            _choose([e[1] / 100 for e in EMOTIONS], F.col("k")), _choose([e[3] / 100 for e in EMOTIONS], F.col("k"))
        ),
    )
    text = F.replace(_choose(TEMPLATES, F.col("k")), F.lit("{v}"), F.floor("value").cast("string"))
    rows = events.select("*", F.col("user_id").cast("string").alias("session_id"), k.alias("k"), ms.alias("ms")).select(
        "*",
        F.min("ms").over(mine).alias("first_ms"),
        F.row_number().over(mine.orderBy("ts", "event_id")).cast("long").alias("pos"),
    )
    rows = rows.select("*", start.alias("start_ms"), text.alias("text"))
    return rows.select(
        "session_id",
        F.concat(F.lit("u"), "event_id").alias("utt_id"),
        "pos",
        F.when(F.col("event_type").isin("click", "view"), "agent")
        .when(F.col("event_type").isin("purchase", "error"), "customer")
        .otherwise("lead")
        .alias("speaker"),
        "start_ms",
        (F.col("start_ms") + F.floor(F.col("value") * 20)).alias("end_ms"),
        "text",
        F.lit(None).cast("long").alias("word_count"),
        label.alias("sent_label"),
        score.cast("long").alias("score_e4"),
        F.when(F.col("k") % 9 != 0, emotion).alias("emotion"),
        (F.col("event_id") % 13 == 0).alias("overlap"),
        ((F.col("event_id") % 97) / 96.0).alias("confidence"),
    )


def _list(values: list) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


#: The same rows in SQL; the emotion map is given as its two names and whole hundredths.
UTTERANCES_SQL = f"""
u0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) k, epoch_us(ts) // 1000 ms,
         min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) first_ms,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) pos FROM events),
u AS (SELECT CAST(user_id AS VARCHAR) session_id, 'u' || event_id utt_id, pos,
        CASE WHEN event_type IN ('click', 'view') THEN 'agent' WHEN event_type IN ('purchase', 'error') THEN 'customer'
             ELSE 'lead' END speaker,
        (ms - first_ms) // 3600 start_ms, (ms - first_ms) // 3600 + CAST(floor(value * 20) AS BIGINT) end_ms,
        replace({_list(TEMPLATES)}[k % {len(TEMPLATES)} + 1], '{{v}}', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) text,
        CASE WHEN event_id % 11 = 0 THEN NULL WHEN (event_id % 101) * 100 < 3500 THEN 'negative'
             WHEN (event_id % 101) * 100 > 6500 THEN 'positive' ELSE 'neutral' END sent_label,
        CASE WHEN event_id % 11 <> 0 THEN (event_id % 101) * 100 END score_e4,
        CASE WHEN k % 9 <> 0 THEN {_list([e[0] for e in EMOTIONS])}[k % 8 + 1] END e1,
        CASE WHEN k % 9 <> 0 THEN {_list([e[1] for e in EMOTIONS])}[k % 8 + 1] END v1,
        CASE WHEN k % 9 <> 0 THEN {_list([e[2] for e in EMOTIONS])}[k % 8 + 1] END e2,
        CASE WHEN k % 9 <> 0 THEN {_list([e[3] for e in EMOTIONS])}[k % 8 + 1] END v2,
        event_id % 13 = 0 overlap, (event_id % 97) / 96.0 confidence FROM u0)"""


def diarized_from_utterances(utterances: DataFrame) -> DataFrame:
    """The same times and speakers as diarized turns."""
    return utterances.select(
        "session_id", "pos", "speaker", "start_ms", "end_ms", "confidence", F.lit(None).cast("double").alias("diarization_confidence")
    )


def asr_from_utterances(utterances: DataFrame) -> DataFrame:
    """Recognised segments: the texts of three utterances in a row, with made-up probabilities."""
    number = F.floor((F.col("pos") - 1) / 3)
    event = F.substring("utt_id", 2, 20).cast("long")
    rows = utterances.select("session_id", number.alias("segment"), "pos", "start_ms", "end_ms", "text", event.alias("event_id"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy("session_id", "segment").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
        (-(F.min("event_id") % 100) / 100.0).alias("avg_logprob"),
        ((F.min("event_id") % 20) / 100.0).alias("no_speech_prob"),
    ).withColumnRenamed("segment", "pos")


ASR_SQL = """asr AS (SELECT session_id, (pos - 1) // 3 pos, min(start_ms) start_ms, max(end_ms) end_ms, string_agg(text, ' ' ORDER BY pos) text,
    -(min(CAST(utt_id[2:] AS BIGINT)) % 100) / 100.0 avg_logprob, (min(CAST(utt_id[2:] AS BIGINT)) % 20) / 100.0 no_speech_prob FROM u GROUP BY session_id, (pos - 1) // 3)"""
