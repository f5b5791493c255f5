"""Registered queries over recordings, summaries and stored results, with their SQL where it has a form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import align, quality, summary
from parley.plans.oracles import sql
from parley.plans.queries import Query, of_bundle
from parley.sources import store
from parley.sources.adapters import ASR_SQL, UTTERANCES_SQL, asr_from_utterances, diarized_from_utterances, utterances_from_events


def _of(table: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """A query over recognised segments and diarized turns."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        turns = utterances_from_events(spark, folder)
        return table(asr_from_utterances(turns), diarized_from_utterances(turns))

    return run


def _aligned(asr: DataFrame, turns: DataFrame) -> DataFrame:
    return align.align_words(align.slice_words(asr), turns)


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    turns = utterances_from_events(spark, folder)
    return turns.select("session_id", F.col("start_ms").alias("created_at"), (F.col("start_ms") * 1000 + F.col("pos")).alias("updated_at"), "text")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    """Every measure of a session; the truth differs from what was recognised in each fifth turn, the summary is the first turn."""
    turns = utterances_from_events(spark, folder)
    asr, diarized = asr_from_utterances(turns), diarized_from_utterances(turns)
    told = F.when(F.col("pos") % 5 == 0, F.lit("no more words")).otherwise(F.col("text"))
    texts = F.array_sort(F.collect_list(F.struct("pos", told.alias("text"))))
    truth = turns.groupBy("session_id").agg(F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("text"))
    summaries = turns.groupBy("session_id").agg(F.min_by("text", "pos").alias("summary"))
    found = quality.evaluation(asr, diarized, _aligned(asr, diarized), truth, turns, summaries)
    return found.withColumn("cer", F.round("cer", 9))


QUERIES: dict[str, Query] = {
    "asr_segments": _of(lambda asr, turns: asr),
    "words": _of(lambda asr, turns: _rounded(align.slice_words(asr), "word_start", "word_end")),
    "aligned_turns": _of(_aligned),
    "merged_blocks": _of(lambda asr, turns: _rounded(align.merge_blocks(_aligned(asr, turns)), "diarization_confidence")),
    "asr_confidence": _of(
        lambda asr, turns: _rounded(align.best_segment(turns.drop("confidence"), asr), "confidence").drop("diarization_confidence")
    ),
    "overlap_windows": _of(lambda asr, turns: align.overlap_windows(turns)),
    "marked_overlap": _of(lambda asr, turns: align.mark_overlap(turns, align.overlap_windows(turns)).drop("diarization_confidence")),
    "speaker_segments": _of(lambda asr, turns: _rounded(align.align(asr, turns), "confidence", "diarization_confidence")),
    "conversation_turns": _of(lambda asr, turns: align.conversation_turns(align.align(asr, turns))),
    "roles": _of(lambda asr, turns: align.roles(turns)),
    "capped_speakers": _of(lambda asr, turns: align.cap_speakers(turns, 2).drop("diarization_confidence")),
    "smoothed_turns": _of(lambda asr, turns: align.smooth_turns(turns)),
    "segment_stats": _of(lambda asr, turns: quality.segment_stats(_aligned(asr, turns))),
    "conversation_stats": _of(lambda asr, turns: quality.conversation_stats(_aligned(asr, turns), turns)),
    "transcript_proxy": _of(lambda asr, turns: quality.transcript_proxy(asr)),
    "diarization_proxy": _of(lambda asr, turns: quality.diarization_proxy(turns)),
    "alignment_health": _of(lambda asr, turns: quality.alignment_health(asr, _aligned(asr, turns))),
    "evaluation": lambda spark, folder: evaluated(spark, folder).drop("wer"),
    "word_errors": lambda spark, folder: evaluated(spark, folder).select("session_id", "wer"),
    "speaker_summaries": of_bundle(
        lambda b: summary.speaker_summaries(b.speakers, b.speaker_sentiment, b.speaker_emotion, b.speaker_flags)
    ),
    "overall_summary": of_bundle(lambda b: b.overall),
    "notable_concerns": of_bundle(lambda b: summary.notable_concerns(b.session_flags)),
    "key_moments": of_bundle(lambda b: summary.key_moments(b.timeline)),
    "transcript_excerpt": lambda spark, folder: summary.transcript_excerpt(utterances_from_events(spark, folder)),
    "latest_records": lambda spark, folder: store.latest_by_key(_versions(spark, folder)),
}

_ALIGNED = f"""{UTTERANCES_SQL}, {ASR_SQL},
  w0 AS (SELECT session_id, pos seg_pos, start_ms, end_ms, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') ws FROM asr),
  w AS (SELECT session_id, seg_pos, ix - 1 "at", ws[ix] word, round(start_ms + (ix - 1) * part, 6) word_start,
        round(CASE WHEN ix = len(ws) THEN end_ms::DOUBLE ELSE start_ms + ix * part END, 6) word_end, start_ms + (ix - 1) * part s,
        CASE WHEN ix = len(ws) THEN end_ms::DOUBLE ELSE start_ms + ix * part END e FROM
        (SELECT *, unnest(range(1, len(ws) + 1)) ix, greatest((end_ms - start_ms)::DOUBLE, 0.001::DOUBLE) / len(ws) part FROM w0)),
  al AS (SELECT u.session_id, u.pos, speaker, start_ms, end_ms, confidence diarization_confidence, string_agg(word, ' ' ORDER BY s, seg_pos, "at") text
         FROM u JOIN w ON u.session_id = w.session_id AND w.e > u.start_ms AND w.s < u.end_ms GROUP BY ALL)"""
_OVERLAP = """ov AS (SELECT DISTINCT a.session_id, greatest(a.start_ms, b.start_ms) s, least(a.end_ms, b.end_ms) e FROM u a JOIN u b
    ON a.session_id = b.session_id AND (a.start_ms, a.end_ms, a.pos) < (b.start_ms, b.end_ms, b.pos) WHERE least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 150),
  oi AS (SELECT *, sum(CASE WHEN s <= m THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY s, e) i FROM
    (SELECT *, max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM ov)),
  ow AS (SELECT session_id, min(s) start_ms, max(e) end_ms FROM oi GROUP BY session_id, i)"""
_TIMES = """tm AS (SELECT session_id, speaker, ms, row_number() OVER (PARTITION BY session_id ORDER BY ms DESC, first) place, ms / sum(ms) OVER (PARTITION BY session_id) share,
    count(*) OVER (PARTITION BY session_id) n FROM (SELECT session_id, speaker, sum(end_ms - start_ms) ms, min((start_ms, pos)) first FROM u GROUP BY ALL))"""
_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"

ORACLES: dict[str, str] = {
    "asr_segments": f"WITH {UTTERANCES_SQL}, {ASR_SQL} SELECT * FROM asr",
    "words": f"WITH {_ALIGNED} SELECT session_id, seg_pos, \"at\", word, word_start, word_end FROM w",
    "aligned_turns": f"WITH {_ALIGNED} SELECT * FROM al",
    "merged_blocks": f"""WITH {_ALIGNED}, mb AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY start_ms, pos) i FROM
      (SELECT *, coalesce(speaker = lag(speaker) OVER o AND start_ms - lag(end_ms) OVER o BETWEEN 0 AND {align.MERGE_GAP_MS}, false) same FROM al WINDOW o AS (PARTITION BY session_id ORDER BY start_ms, pos)))
      SELECT session_id, arg_min(pos, (start_ms, pos)) pos, any_value(speaker) speaker, min(start_ms) start_ms, arg_max(end_ms, (start_ms, pos)) end_ms,
      trim(string_agg(text, ' ' ORDER BY start_ms, pos)) text,
      round(list_reduce(list(diarization_confidence ORDER BY start_ms, pos), lambda a, x: (a + x) / 2), 6) diarization_confidence FROM mb GROUP BY session_id, i""",
    "asr_confidence": f"WITH {_ALIGNED}, b AS (SELECT u.session_id, u.pos, arg_max(1 / (1 + exp(-avg_logprob)) * (1 - no_speech_prob), "
    "(least(u.end_ms, a.end_ms) - greatest(u.start_ms, a.start_ms), -a.pos)) c FROM u JOIN asr a ON u.session_id = a.session_id "
    "AND least(u.end_ms, a.end_ms) > greatest(u.start_ms, a.start_ms) GROUP BY ALL) SELECT session_id, pos, speaker, start_ms, end_ms, "
    "round(coalesce(c, 0.5), 6) confidence FROM u LEFT JOIN b USING (session_id, pos)",
    "overlap_windows": f"WITH {UTTERANCES_SQL}, {_OVERLAP} SELECT * FROM ow",
    "marked_overlap": f"WITH {UTTERANCES_SQL}, {_OVERLAP}, h AS (SELECT *, EXISTS (SELECT 1 FROM ow WHERE ow.session_id = u.session_id AND "
    "least(ow.end_ms, u.end_ms) > greatest(ow.start_ms, u.start_ms)) hit FROM u) SELECT session_id, pos, CASE WHEN hit THEN 'SPEAKER_UNKNOWN' ELSE speaker END speaker, "
    "start_ms, end_ms, CASE WHEN hit THEN least(coalesce(confidence, 1.0), 0.55) ELSE confidence END confidence, hit overlap FROM h",
    "diarization_proxy": f"WITH {UTTERANCES_SQL} SELECT session_id, count(DISTINCT speaker) num_speakers, count(*) num_segments, "
    "printf('%.3f', avg(end_ms - start_ms) / 1000)::DOUBLE avg_segment_sec FROM u GROUP BY 1",
    "alignment_health": f"WITH {_ALIGNED}, n AS (SELECT session_id, count(*) s FROM al GROUP BY 1) SELECT session_id, a asr_segments, coalesce(s, 0) speaker_segments, "
    "round(coalesce(s, 0) / a, 3) coverage, greatest(a - coalesce(s, 0), 0) unassigned_asr_segments_est "
    "FROM (SELECT session_id, count(*) a FROM asr GROUP BY 1) LEFT JOIN n USING (session_id)",
    "roles": f"WITH {UTTERANCES_SQL}, {_TIMES} SELECT session_id, speaker, CASE place WHEN 1 THEN 'CUSTOMER' WHEN 2 THEN 'AGENT' ELSE speaker END role FROM tm",
    "capped_speakers": f"WITH {UTTERANCES_SQL}, {_TIMES} SELECT session_id, pos, CASE WHEN place > 2 OR share < 0.05 THEN 'SPEAKER_UNKNOWN' ELSE speaker END speaker, "
    "start_ms, end_ms, CASE WHEN place > 2 OR share < 0.05 THEN least(confidence, 0.6) ELSE confidence END confidence, n > 2 cap_applied FROM u JOIN tm USING (session_id, speaker)",
    "segment_stats": f"WITH {_ALIGNED} SELECT session_id, speaker, ms / 1000 total_speaking_time, segment_count, total_words, longest / 1000 longest_monologue, "
    "first / 1000 first_spoke_at, last / 1000 last_spoke_at, round(ms / 1000 / segment_count, 6) avg_segment_length, "
    "round(CASE WHEN ms > 0 THEN total_words / ms * 60000 ELSE 0 END, 6) wpm, round(ms / 1000 / greatest(sum(ms) OVER x / 1000, 1), 6) speaking_ratio, "
    "round(total_words / greatest(sum(total_words) OVER x, 1), 6) word_ratio FROM (SELECT session_id, speaker, sum(end_ms - start_ms)::BIGINT ms, count(*) segment_count, "
    "sum(len(string_split(text, ' ')))::BIGINT total_words, max(end_ms - start_ms) longest, min(start_ms) first, max(end_ms) last FROM al GROUP BY ALL) WINDOW x AS (PARTITION BY session_id)",
    "conversation_stats": f"WITH {_ALIGNED} SELECT session_id, (l - f) / 1000 total_duration, n total_segments, w total_words, round((l - f) / 1000 / n, 6) avg_turn_length, "
    "s speaker_count, f / 1000 conversation_start, l / 1000 conversation_end FROM (SELECT session_id, count(*) n, sum(len(string_split(text, ' ')))::BIGINT w, count(DISTINCT speaker) s "
    "FROM al GROUP BY 1) JOIN (SELECT session_id, arg_min(start_ms, pos) f, arg_max(end_ms, pos) l FROM u GROUP BY 1) USING (session_id)",
    "transcript_proxy": f"WITH {UTTERANCES_SQL}, {ASR_SQL}, t AS (SELECT session_id, arg_max(end_ms, pos) l, count(*) n, sum(end_ms - start_ms)::BIGINT sp, "
    "string_split(lower(string_agg(text, ' ' ORDER BY pos)), ' ') k FROM asr GROUP BY 1) SELECT session_id, round(l / 1000, 3) duration_sec, len(k) total_words, n num_segments, "
    "printf('%.3f', len(k) / greatest(l / 1000, 1e-6)::DOUBLE)::DOUBLE words_per_sec, printf('%.3f', sp / n / 1000)::DOUBLE avg_segment_sec, "
    "printf('%.3f', 1 - len(list_distinct(k)) / len(k))::DOUBLE repetition_ratio FROM t",
    "notable_concerns": sql(
        f"SELECT session_id, number, concern FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY r DESC, p) number FROM "
        f"(SELECT session_id, coalesce(speaker || ': ', '') || reason concern, max({_RANK}) r, min(CASE WHEN speaker IS NULL THEN 1000000 + list_position("
        "['negative_session_mood', 'declining_session_tone', 'conversation_escalation', 'conversation_inconsistency'], \"type\") "
        "ELSE first_seq * 10 + list_position(['speaker_dominance', 'high_tension'], \"type\") END) p "
        "FROM ff LEFT JOIN sp USING (session_id, speaker) GROUP BY ALL)) WHERE number <= 6",
        "ff", "sp",
    ),
    "key_moments": sql(
        "SELECT session_id, number, marker_id, 'At ' || printf('%.2f', time_sec) || 's, ' || coalesce(speaker || ' ', '') || 'showed a ' || replace(\"type\", '_', ' ') "
        f"|| ' signal (' || severity || ').' moment FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_RANK} DESC, time_sec DESC, place) number FROM tl) WHERE number <= 5",
        "tl",
    ),
    "transcript_excerpt": f"WITH {UTTERANCES_SQL} SELECT session_id, CASE WHEN length(t) > 4000 THEN t[1:4000] || ' ... [TRUNCATED]' ELSE t END transcript, length(t) > 4000 cut FROM "
    "(SELECT session_id, string_agg(text, ' ' ORDER BY pos) t FROM u GROUP BY 1)",
    "latest_records": f"WITH {UTTERANCES_SQL} SELECT session_id, min(start_ms) created_at, max(start_ms * 1000 + pos) updated_at, arg_max(text, start_ms * 1000 + pos) text FROM u GROUP BY 1",
}


def payloads_from_utterances(u: DataFrame) -> DataFrame:
    """One JSON payload per session, with the flaws that a source might have."""
    odd = F.col("pos") % 17
    item = F.to_json(
        F.struct(
            F.when(odd != 3, F.col("utt_id")).alias("id"),
            F.concat(F.lit(" "), F.col("speaker"), F.lit("-one ")).alias("speaker"),
            (F.col("start_ms") / 1000).alias("start"),
            F.when(odd != 5, F.col("end_ms") / 1000).alias("end"),
            "text",
            F.when(odd == 7, 1.5).otherwise(F.col("confidence")).alias("confidence"),
            F.struct(F.upper("sent_label").alias("label"), (F.col("score_e4") / 10000).alias("score")).alias("sentiment"),
            "overlap",
        )
    )
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("j")))), lambda x: x["j"])
    key = F.when(F.col("session_id").cast("long") % 7 != 0, F.concat(F.lit('"session_id":"'), "session_id", F.lit('",'))).otherwise("")
    rows = u.groupBy("session_id").agg(items.alias("items"))
    return rows.select(
        F.col("session_id").alias("payload_id"), F.concat(F.lit("{"), key, F.lit('"utterances":['), F.array_join("items", ","), F.lit("]}")).alias("value")
    )


def _payloads(table: Callable[[DataFrame], DataFrame]) -> Query:
    from parley.operators import payloads

    return lambda spark, folder: table(payloads.read_payloads(payloads_from_utterances(utterances_from_events(spark, folder))))


def _payload_queries() -> dict[str, Query]:
    from parley.operators import payloads as p

    return {
        "payload_issues": _payloads(p.payload_issues),
        "payload_status": _payloads(lambda v: p.payload_status(v, p.payload_issues(v))),
        "normalized_utterances": _payloads(lambda v: p.normalize(v).drop("emotion")),
        "session_advisories": _payloads(lambda v: p.session_advisories(p.normalize(v))),
        "out_of_order": lambda spark, folder: p.out_of_order(utterances_from_events(spark, folder)),
        "speaker_lists": lambda spark, folder: p.speaker_lists(utterances_from_events(spark, folder)).select(
            "session_id", F.array_join("speakers", ",").alias("speakers"), "duration_ms"
        ),
    }


QUERIES |= _payload_queries()
FLAWS = """SELECT session_id payload_id, 'missing_required_field' code, 'session_id' field, 'error' severity FROM u WHERE CAST(session_id AS BIGINT) % 7 = 0 GROUP BY 1
  UNION ALL SELECT session_id, 'missing_end', 'utterances[' || (pos - 1) || '].end', 'error' FROM u WHERE pos % 17 = 5
  UNION ALL SELECT session_id, 'invalid_confidence', 'utterances[' || (pos - 1) || '].confidence', 'warning' FROM u WHERE pos % 17 = 7
  UNION ALL SELECT session_id, 'irregular_order', 'utterances[' || (pos - 1) || '].start', 'warning' FROM
    (SELECT *, lag(start_ms) OVER (PARTITION BY session_id ORDER BY pos) was FROM u) WHERE start_ms < was"""
ORACLES |= {
    "payload_issues": f"WITH {UTTERANCES_SQL} {FLAWS}",
    "payload_status": f"WITH {UTTERANCES_SQL}, i AS ({FLAWS}) SELECT payload_id, CASE WHEN count_if(severity = 'error') > 0 THEN 'error' WHEN count(code) > 0 THEN 'warning' ELSE 'ok' END status, "
    "count(code) n_issues FROM (SELECT DISTINCT session_id payload_id FROM u) LEFT JOIN i USING (payload_id) GROUP BY 1",
    "session_advisories": f"""WITH {UTTERANCES_SQL} SELECT session_id, unnest(CASE WHEN len(codes) > 0 THEN codes ELSE [NULL] END) code FROM
      (SELECT session_id, list_filter([CASE WHEN max(end_ms) <= 0 THEN 'no_duration' END, CASE WHEN count(*) = 1 THEN 'single_utterance' END,
         CASE WHEN count(DISTINCT speaker) = 1 THEN 'single_speaker' END, CASE WHEN count(*) FILTER (text = '') > 0 THEN 'empty_texts' END,
         CASE WHEN count(sent_label) = 0 THEN 'no_sentiment' END, 'no_emotion'], lambda x: x IS NOT NULL) codes FROM
         (SELECT CASE WHEN CAST(session_id AS BIGINT) % 7 = 0 THEN 'unknown_session:' || session_id ELSE session_id END session_id,
            CASE WHEN pos % 17 = 5 THEN start_ms ELSE end_ms END end_ms, speaker, text, sent_label FROM u) GROUP BY 1)""",
    "out_of_order": f"WITH {UTTERANCES_SQL} SELECT session_id, count(*) FILTER (start_ms < was) out_of_order FROM "
    "(SELECT *, lag(start_ms) OVER (PARTITION BY session_id ORDER BY pos) was FROM u) GROUP BY 1",
    "speaker_lists": f"WITH {UTTERANCES_SQL} SELECT session_id, string_agg(speaker, ',' ORDER BY first) speakers, max(last) duration_ms FROM "
    "(SELECT session_id, speaker, min(pos) first, max(end_ms) last FROM u GROUP BY ALL) GROUP BY 1",
    "normalized_utterances": f"""WITH {UTTERANCES_SQL} SELECT session_id, utt_id, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, utt_id) pos, speaker, start_ms, end_ms,
      text, word_count, sent_label, score_e4, overlap, confidence FROM (SELECT CASE WHEN CAST(session_id AS BIGINT) % 7 = 0 THEN 'unknown_session:' || session_id ELSE session_id END session_id,
      CASE WHEN pos % 17 = 3 THEN 'utt_' || pos ELSE utt_id END utt_id, upper(speaker) || '_ONE' speaker, start_ms, CASE WHEN pos % 17 = 5 THEN start_ms ELSE end_ms END end_ms,
      text, len(string_split(text, ' ')) word_count, sent_label, score_e4, overlap, CASE WHEN pos % 17 <> 7 THEN round(confidence, 4) END confidence FROM u)""",
}
ORACLES["evaluation"] = f"""WITH {UTTERANCES_SQL}, {ASR_SQL}, said AS (SELECT session_id, string_agg(text, ' ' ORDER BY pos) s FROM asr GROUP BY 1),
  t AS (SELECT session_id, string_agg(CASE WHEN pos % 5 = 0 THEN 'no more words' ELSE text END, ' ' ORDER BY pos) t, arg_min(text, pos) f,
    count(sent_label) labelled, count(*) FILTER (sent_label = 'positive') p, count(*) FILTER (sent_label = 'neutral') n, count(*) FILTER (sent_label = 'negative') g FROM u GROUP BY 1)
  SELECT a.* RENAME (num_segments AS asr_count), d.* EXCLUDE (session_id) RENAME (num_segments AS diar_count, avg_segment_sec AS avg_turn_sec), h.* EXCLUDE (session_id), labelled,
    round(p / labelled, 4) positive_share, round(n / labelled, 4) neutral_share, round(g / labelled, 4) negative_share,
    len(regexp_split_to_array(f, ' ')) summary_words, len(regexp_split_to_array(s, ' ')) transcript_words,
    round(len(regexp_split_to_array(f, ' ')) / len(regexp_split_to_array(s, ' ')), 4) compression_ratio, round(levenshtein(t, s) / length(t), 9) cer
  FROM ({ORACLES["transcript_proxy"]}) a LEFT JOIN ({ORACLES["diarization_proxy"]}) d USING (session_id) LEFT JOIN ({ORACLES["alignment_health"]}) h USING (session_id)
  LEFT JOIN t USING (session_id) LEFT JOIN said USING (session_id)"""
