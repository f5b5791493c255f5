"""Raw session payloads: validation of JSON by type, and normalisation to typed utterances.

A payload is one JSON object per row, read as VARIANT, because a number, a text, a boolean and a list are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.metrics import word_count

NUMBERS = ["BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"]  # and DECIMAL(p,s)
NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
SENTIMENTS = ["positive", "neutral", "negative"]
# Words and numbers that mean true.
TRUE_WORDS = ["true", "1", "yes", "y"]
UNKNOWN_SESSION, UNKNOWN_SPEAKER = "unknown_session", "UNKNOWN"


def read_payloads(lines: DataFrame, id_col: str = "payload_id", json_col: str = "value") -> DataFrame:
    """``payload_id`` and the payload as VARIANT; null for what is not JSON."""
    return lines.select(F.col(id_col).alias("payload_id"), F.try_parse_json(json_col).alias("p"))


def _kind(v: Column, path: str) -> Column:
    """Type of a field as SQL text; null if it is missing, VOID if it is null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _number(kind: Column) -> Column:
    return F.coalesce(kind.isin(NUMBERS) | kind.startswith("DECIMAL("), F.lit(False))


def _missing(kind: Column) -> Column:
    return kind.isNull() | (kind == "VOID")


def _issue(holds: Column, code: str, field: Column | str, severity: str) -> Column:
    where = F.lit(field) if isinstance(field, str) else field
    return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), where.alias("field"), F.lit(severity).alias("severity")))


def _elements(payloads: DataFrame) -> DataFrame:
    items = F.try_variant_get("p", "$.utterances", "array<variant>")
    return payloads.select("payload_id", F.posexplode(items).alias("pos", "u"))


#: Fields of an utterance whose types are checked.
FIELDS = ("start", "end", "id", "speaker", "text", "overlap", "word_count", "confidence", "diarization_confidence", "sentiment", "emotion")


def payload_issues(payloads: DataFrame) -> DataFrame:
    """Errors and warnings of each payload: those of its top level and of every utterance.

    A payload is parsed once: its own issues go with its first element, and with an empty one where it has none. The type
    of a field is taken once, as a column that the checks share, and only types and times pass the window.
    """
    p = F.col("p")
    top = F.schema_of_variant(p)
    is_object = F.coalesce(top.startswith("OBJECT"), F.lit(False))
    items = F.try_variant_get(p, "$.utterances", "array<variant>")
    heads = payloads.select(
        "payload_id", is_object.alias("is_object"), _kind(p, "$.session_id").alias("session"), _kind(p, "$.duration_sec").alias("duration"),
        _kind(p, "$.speakers").alias("speakers"), F.try_variant_get(p, "$.utterances", "variant").isNotNull().alias("given"), F.try_variant_get(p, "$.duration_sec", "double").alias("seconds"),
        items.alias("items"),
    )
    is_object, session, duration, speakers, given = (F.col(c) for c in ("is_object", "session", "duration", "speakers", "given"))
    listed = F.col("items").isNotNull()
    issues = F.array(
        _issue(~is_object, "invalid_payload_type", "root", "error"),
        _issue(is_object & session.isNull(), "missing_required_field", "session_id", "error"),
        _issue(is_object & ~given, "missing_required_field", "utterances", "error"),
        _issue(is_object & ~_missing(session) & ~((session == "STRING") | session.isin("BIGINT", "INT", "SMALLINT", "TINYINT")), "invalid_session_id", "session_id", "error"),
        _issue(is_object & ~_missing(duration) & ~(_number(duration) & (F.col("seconds") >= 0)), "invalid_duration", "duration_sec", "warning"),
        _issue(is_object & ~_missing(speakers) & ~speakers.startswith("ARRAY"), "invalid_speakers", "speakers", "warning"),
        _issue(is_object & given & ~listed, "invalid_utterances", "utterances", "error"),
        _issue(listed & (F.size("items") == 0), "empty_utterances", "utterances", "error"),
    )
    heads = heads.select("payload_id", F.array_compact(issues).alias("whole"), "items")

    u = F.col("u")
    rows = heads.select("payload_id", "whole", F.posexplode_outer("items").alias("pos", "u"))
    value = lambda name, kind: F.try_variant_get(u, f"$.{name}", kind).alias(f"{name}_value")
    numbers = ("start", "end", "confidence", "diarization_confidence")
    rows = rows.select(
        "payload_id", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("whole")).alias("whole"), "pos", F.schema_of_variant(u).startswith("OBJECT").alias("is_item"),
        *[_kind(u, f"$.{name}").alias(name) for name in FIELDS], *[value(name, "double") for name in numbers], value("word_count", "bigint"),
    )
    at = lambda name: F.concat(F.lit("utterances["), "pos", F.lit(f"].{name}"))
    is_item, kind, of = F.col("is_item"), {name: F.col(name) for name in FIELDS}, lambda name: F.col(f"{name}_value")
    numeric = lambda name: _number(kind[name])
    timed = numeric("start") & numeric("end")
    before = Window.partitionBy("payload_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("was", F.last(F.when(is_item & numeric("start"), of("start")), ignorenulls=True).over(before))
    checks = [_issue(~is_item, "invalid_utterance_type", F.concat(F.lit("utterances["), "pos", F.lit("]")), "error")]
    for name in ("start", "end"):
        checks.append(_issue(is_item & _missing(kind[name]), f"missing_{name}", at(name), "error"))
        checks.append(_issue(is_item & ~_missing(kind[name]) & ~(numeric(name) & (of(name) >= 0)), f"invalid_{name}", at(name), "error"))
    checks.append(_issue(is_item & timed & (of("end") < of("start")), "end_before_start", at("end"), "error"))
    checks.append(_issue(is_item & numeric("start") & (of("start") < F.col("was")), "irregular_order", at("start"), "warning"))
    for name, kinds in (("id", ["STRING", "BIGINT"]), ("speaker", ["STRING"]), ("text", ["STRING"]), ("overlap", ["BOOLEAN"])):
        checks.append(_issue(is_item & ~_missing(kind[name]) & ~kind[name].isin(kinds), f"invalid_{name}", at(name), "warning"))
    good = (kind["word_count"] == "BIGINT") & (of("word_count") >= 0)
    checks.append(_issue(is_item & ~_missing(kind["word_count"]) & ~good, "invalid_word_count", at("word_count"), "warning"))
    for name in ("confidence", "diarization_confidence"):
        inside = numeric(name) & of(name).between(0, 1)
        checks.append(_issue(is_item & ~_missing(kind[name]) & ~inside, f"invalid_{name}", at(name), "warning"))
    for name in ("sentiment", "emotion"):
        checks.append(_issue(is_item & ~_missing(kind[name]) & ~kind[name].startswith("OBJECT"), f"invalid_{name}", at(name), "warning"))
    found = F.concat(F.coalesce("whole", F.array().cast(heads.schema["whole"].dataType)), F.array_compact(F.array(*checks)))
    return rows.select("payload_id", F.explode(found).alias("i")).select("payload_id", "i.code", "i.field", "i.severity")


def payload_status(payloads: DataFrame, issues: DataFrame) -> DataFrame:
    """Each payload is ok, has warnings, or is rejected with an error."""
    worst = issues.groupBy("payload_id").agg(F.bool_or(F.col("severity") == "error").alias("error"), F.count("*").alias("n_issues"))
    rows = payloads.select("payload_id").join(worst, "payload_id", "left")
    status = F.when(F.col("error"), "error").when(F.col("n_issues") > 0, "warning").otherwise("ok")
    return rows.select("payload_id", status.alias("status"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def _text(v: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def real_number(v: Column, path: str) -> Column:
    """A number, or a text that is one; never a boolean."""
    kind, text = _kind(v, path), F.try_variant_get(v, path, "string")
    return F.when(_number(kind), F.try_variant_get(v, path, "double")).when((kind == "STRING") & text.rlike(NUMERIC_TEXT), text.try_cast("double"))


def clean_speaker(name: Column) -> Column:
    upper = F.regexp_replace(F.translate(F.upper(F.trim(name)), "- ", "__"), "_+", "_")
    return F.coalesce(F.nullif(upper, F.lit("")), F.lit(UNKNOWN_SPEAKER))


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _milliseconds(seconds: Column) -> Column:
    return F.round(F.when(seconds >= 0, seconds) * 1000).cast("long")


def _share(v: Column, path: str) -> Column:
    value = real_number(v, path)
    return F.when(value.between(0, 1), F.round(value, 4))


def normalize(payloads: DataFrame) -> DataFrame:
    """Typed utterances of payloads, in the columns that the operators take, sorted within their session.

    A payload without a session id gets one of its own, so that such payloads do not become one giant session.
    """
    own = F.concat(F.lit(f"{UNKNOWN_SESSION}:"), F.col("payload_id").cast("string"))
    head = payloads.select("payload_id", F.coalesce(_text(F.col("p"), "$.session_id"), own).alias("session_id"))
    u = F.col("u")
    start = F.coalesce(_milliseconds(real_number(u, "$.start")), F.lit(0).cast("long"))
    end = F.greatest(start, F.coalesce(_milliseconds(real_number(u, "$.end")), start))
    label, score = F.lower(_text(u, "$.sentiment.label")), _share(u, "$.sentiment.score")
    emotions = F.map_filter(F.try_variant_get(u, "$.emotion.values", "map<string,double>"), lambda k, v: v.between(0, 1))
    words = F.try_variant_get(u, "$.word_count", "bigint")
    text = clean_text(F.try_variant_get(u, "$.text", "string"))
    rows = _elements(payloads).where(F.schema_of_variant(u).startswith("OBJECT")).select(
        "payload_id",
        F.coalesce(_text(u, "$.id"), F.concat(F.lit("utt_"), F.col("pos") + 1)).alias("utt_id"),
        F.col("pos").cast("long").alias("given"),
        clean_speaker(F.try_variant_get(u, "$.speaker", "string")).alias("speaker"),
        start.alias("start_ms"),
        end.alias("end_ms"),
        text.alias("text"),
        F.coalesce(F.when(words >= 0, words), word_count(text)).alias("word_count"),
        F.when(label.isin(SENTIMENTS), label).alias("sent_label"),
        F.round(score * 10000).cast("long").alias("score_e4"),
        F.when(F.size(emotions) > 0, emotions).alias("emotion"),
        F.lower(F.coalesce(_text(u, "$.overlap"), F.lit(""))).isin(TRUE_WORDS).alias("overlap"),
        _share(u, "$.confidence").alias("confidence"),
    )
    order = Window.partitionBy("session_id").orderBy("start_ms", "end_ms", "utt_id")
    rows = rows.join(head, "payload_id").withColumn("pos", F.row_number().over(order).cast("long"))
    return rows.select(
        "session_id", "utt_id", "pos", "speaker", "start_ms", "end_ms", "text", "word_count", "sent_label", "score_e4", "emotion", "overlap", "confidence",
    )


def session_advisories(utterances: DataFrame) -> DataFrame:
    """What a session lacks, as codes; a session that lacks nothing has one row without a code."""
    sums = utterances.groupBy("session_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("speaker").alias("speakers"),
        F.count_if(F.col("text") == "").alias("empty"),
        F.count_if(F.col("word_count").isNull()).alias("uncounted"),
        F.count("sent_label").alias("sentiments"),
        F.count("emotion").alias("emotions"),
        F.max("end_ms").alias("last"),
    )
    codes = F.array(
        F.when(F.col("last") <= 0, "no_duration"),
        F.when(F.col("n") == 1, "single_utterance"),
        F.when(F.col("speakers") == 1, "single_speaker"),
        F.when(F.col("empty") > 0, "empty_texts"),
        F.when(F.col("uncounted") > 0, "missing_word_counts"),
        F.when(F.col("sentiments") == 0, "no_sentiment"),
        F.when(F.col("emotions") == 0, "no_emotion"),
    )
    return sums.select("session_id", F.explode_outer(F.array_compact(codes)).alias("code"))


def out_of_order(utterances: DataFrame) -> DataFrame:
    """How often an utterance starts before the one given before it."""
    before = F.lag("start_ms").over(Window.partitionBy("session_id").orderBy("pos"))
    rows = utterances.select("session_id", (F.col("start_ms") < before).alias("back"))
    return rows.groupBy("session_id").agg(F.count_if("back").alias("out_of_order"))


def speaker_lists(utterances: DataFrame) -> DataFrame:
    """Speakers of each session in the order of first speech, and its length."""
    first = utterances.groupBy("session_id", "speaker").agg(F.min("pos").alias("first"), F.max("end_ms").alias("last"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("first", "speaker"))), lambda s: s["speaker"])
    return first.groupBy("session_id").agg(names.alias("speakers"), F.max("last").alias("duration_ms"))
