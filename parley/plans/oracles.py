"""SQL with the results of the registered queries, for DuckDB over the same tables.

``PARTS`` are named subqueries; a query's SQL is made of those it needs, in order.
"""

from __future__ import annotations

from parley.functions import lexicon as words
from parley.sources.adapters import UTTERANCES_SQL, _list



def _dominant(keys: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY share DESC, first) = 1 dominant FROM
      (SELECT *, round(total / sum(total) OVER (PARTITION BY {keys}), 4) share FROM
        (SELECT {keys}, lower(e) emotion, sum(v) total, min(pos * 1000 + ix) first FROM
           (SELECT *, e1 e, v1 v, 0 ix FROM s WHERE e1 IS NOT NULL UNION ALL SELECT *, e2, v2, 1 FROM s WHERE e1 IS NOT NULL)
         GROUP BY ALL)))
      JOIN (SELECT {keys}, count(*) sample_count FROM s WHERE e1 IS NOT NULL GROUP BY ALL) USING ({keys})"""


def _sentiment(keys: str) -> str:
    return f"""SELECT {keys}, arg_max(label, (n, -first)) label, round(sum(total) / sum(n) / 10000, 4) avg_score,
      coalesce(sum(n) FILTER (label = 'positive'), 0)::BIGINT positive_count,
      coalesce(sum(n) FILTER (label = 'neutral'), 0)::BIGINT neutral_count,
      coalesce(sum(n) FILTER (label = 'negative'), 0)::BIGINT negative_count, sum(n)::BIGINT sample_count
      FROM (SELECT {keys}, lower(sent_label) label, count(*) n, sum(score_e4) total, min(pos) first FROM s
            WHERE sent_label IS NOT NULL GROUP BY ALL) GROUP BY ALL"""


def _assessment(signals: str, kind: str, nothing: str, steps: list[tuple[float, str]]) -> str:
    level = "CASE " + " ".join(f"WHEN score >= {at} THEN '{name}'" for at, name in steps) + " ELSE 'none' END"
    return f"""SELECT session_id, level, score, signal_count, primary_speaker,
      CASE WHEN level = 'none' THEN '{nothing}' ELSE '{kind} level is ' || level || ', driven by ' || names
        || '. Primary speaker of concern: ' || primary_speaker || '.' END summary
      FROM (SELECT *, {level} level FROM
        (SELECT d.session_id, least(1.0, coalesce(total, 0) / 10000) score, coalesce(n, 0) signal_count,
                coalesce(b.speaker, d.dominant_speaker) primary_speaker, names FROM dominant d
         LEFT JOIN (SELECT session_id, sum(round(score * 10000)::BIGINT) total, count(*) n,
                      array_to_string(list(signal_type ORDER BY place)[1:3], ', ') names FROM {signals} GROUP BY ALL) USING (session_id)
         LEFT JOIN (SELECT session_id, arg_max(speaker, (blame, -named)) speaker FROM
                      (SELECT session_id, speaker, sum(round(score * 10000)::BIGINT) blame, min(place) named FROM {signals}
                       WHERE speaker IS NOT NULL GROUP BY ALL) GROUP BY ALL) b USING (session_id)))"""


_tokens = "list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z'']+'), lambda t: replace(lower(t), '''', ''))"
_kind = (
    f"CASE WHEN list_contains({_list(words.NEGATIONS)}, t) THEN 0 WHEN list_contains({_list(words.POSITIVE_WORDS)}, t) THEN 1 "
    f"WHEN list_contains({_list(words.NEGATIVE_WORDS)}, t) THEN -1 ELSE 0 END"
)
_turned = f"list_has_any(tokens[greatest(i - 3, 1):i - 1], {_list(words.NEGATIONS)})"


def _says(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(padded, ' {p} ')" for p in phrases) + ")"


def _turnaround(family: int, rows: str, state: str, reach: int, verb: str, name: str) -> str:
    return f"""SELECT session_id, {family} family, seq, speaker, was_ms from_ms, end_ms, true hit,
      speaker || ' {verb} from ''' || was_name || ''' to ''' || {name} || ''' within {reach // 1000}s.' reason FROM
      (SELECT *, lag({state}) OVER w was, lag({name}) OVER w was_name, lag(start_ms) OVER w was_ms, start_ms - lag(end_ms) OVER w since FROM r WHERE {rows}
       WINDOW w AS (PARTITION BY session_id, speaker ORDER BY start_ms, end_ms, utt_id))
      WHERE was <> {state} AND since BETWEEN 0 AND {reach}"""


PARTS: dict[str, str] = {
    "s": """SELECT *, row_number() OVER w seq, lag(utt_id) OVER w prev_utt_id, lag(speaker) OVER w prev_speaker,
        lag(start_ms) OVER w prev_start_ms, lag(end_ms) OVER w prev_end_ms, start_ms - lag(end_ms) OVER w gap_ms,
        greatest(0, end_ms - start_ms) duration_ms, contains(text, '?') question,
        len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) words,
        coalesce(speaker <> lag(speaker) OVER w AND start_ms < lag(end_ms) OVER w, false) interrupts FROM u
        WINDOW w AS (PARTITION BY session_id ORDER BY start_ms, end_ms, utt_id)""",
    "sm": """SELECT session_id, round(sum(duration_ms) / 1000, 3) total_duration_sec, count(DISTINCT speaker) total_speakers,
        count(*) total_utterances, sum(words)::BIGINT total_words, round(sum(words) / count(*), 3) avg_utterance_length_words,
        round(sum(duration_ms) / count(*) / 1000, 3) avg_utterance_duration_sec, count_if(question)::BIGINT total_questions,
        count(*) FILTER (gap_ms > 0) total_pauses,
        coalesce(round(sum(gap_ms) FILTER (gap_ms > 0) / count(*) FILTER (gap_ms > 0) / 1000, 3), 0.0) avg_pause_sec,
        coalesce(round(max(gap_ms) FILTER (gap_ms > 0) / 1000, 3), 0.0) max_pause_sec FROM s GROUP BY session_id""",
    "sp": """SELECT session_id, speaker, round(time / 1000, 3) speaking_time_sec, utterance_count, word_count,
        CASE WHEN sum(time) OVER x > 0 THEN round(time / sum(time) OVER x, 4) ELSE 0.0 END speaking_ratio,
        CASE WHEN sum(word_count) OVER x > 0 THEN round(word_count / sum(word_count) OVER x, 4) ELSE 0.0 END word_ratio,
        round(word_count / utterance_count, 3) avg_utterance_length_words, round(time / utterance_count / 1000, 3) avg_utterance_duration_sec,
        question_count, interruption_count, overlap_count, round(first_ms / 1000, 3) first_spoke_at_sec,
        round(last_ms / 1000, 3) last_spoke_at_sec, first_seq FROM
        (SELECT session_id, speaker, sum(duration_ms)::BIGINT time, count(*) utterance_count, sum(words)::BIGINT word_count,
           count_if(question)::BIGINT question_count, count_if(interrupts)::BIGINT interruption_count, count_if(overlap)::BIGINT overlap_count,
           arg_min(start_ms, seq) first_ms, arg_max(end_ms, seq) last_ms, min(seq) first_seq FROM s GROUP BY ALL)
        WINDOW x AS (PARTITION BY session_id)""",
    "dominant": "SELECT session_id, arg_max(speaker, (speaking_ratio, -first_seq)) dominant_speaker, max(speaking_ratio) speaking_ratio FROM sp GROUP BY 1",
    "sent": _sentiment("session_id"),
    "sent_sp": _sentiment("session_id, speaker"),
    "emo": _dominant("session_id"),
    "emo_sp": "SELECT session_id, speaker, emotion dominant_emotion, share dominant_share, sample_count FROM ("
    + _dominant("session_id, speaker")
    + ") WHERE dominant",
    "p": """SELECT *, lag(score_e4) OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, utt_id) prev_score_e4
        FROM s WHERE sent_label IS NOT NULL""",
    "trend": """SELECT session_id, CASE WHEN points < 2 THEN 'stable' WHEN d >= 800 THEN 'improving' WHEN d <= -800 THEN 'declining'
        WHEN abs(d) < 300 THEN 'stable' ELSE 'mixed' END direction, d / 10000 slope, points FROM
        (SELECT session_id, CASE WHEN count(*) < 2 THEN 0 ELSE arg_max(score_e4, seq) - arg_min(score_e4, seq) END d, count(*) points
         FROM p GROUP BY 1)""",
    "vol": """SELECT session_id, round(greatest(0.0, least(1.0, 0.65 * coalesce(step / 10000, 0.0) + 0.35 * coalesce(share, 0.0))), 4)
        emotion_volatility FROM (SELECT DISTINCT session_id FROM s)
        LEFT JOIN (SELECT session_id, avg(abs(score_e4 - prev_score_e4)) step FROM p GROUP BY 1) USING (session_id)
        LEFT JOIN (SELECT session_id, CASE WHEN count(*) > 1 THEN count(*) FILTER (top <> was) / (count(*) - 1) ELSE 0.0 END share FROM
          (SELECT session_id, CASE WHEN v2 > v1 THEN e2 ELSE e1 END top,
             lag(CASE WHEN v2 > v1 THEN e2 ELSE e1 END) OVER (PARTITION BY session_id ORDER BY pos) was FROM s WHERE e1 IS NOT NULL)
          GROUP BY 1) USING (session_id)""",
    "m_dominance": """SELECT session_id, 'dominance_' || speaker marker_id, 'dominance_window' "type", first_spoke_at_sec time_sec, speaker,
        CASE WHEN speaking_ratio >= 0.75 OR word_ratio >= 0.75 THEN 'high' ELSE 'medium' END severity,
        first_spoke_at_sec start_sec, last_spoke_at_sec end_sec, speaker || ' shows dominant participation across the session.' reason FROM sp WHERE speaking_ratio >= 0.6 OR word_ratio >= 0.6""",
    "m_tension": """SELECT session_id, 'high_tension_' || speaker marker_id, 'high_tension' "type", first_spoke_at_sec time_sec, speaker,
        CASE WHEN interruption_count >= 4 OR overlap_count >= 4 THEN 'high' ELSE 'medium' END severity,
        first_spoke_at_sec start_sec, last_spoke_at_sec end_sec,
        speaker || ' is involved in repeated interruptions or overlaps, which may indicate elevated conversational tension.' reason FROM sp WHERE interruption_count >= 2 OR overlap_count >= 2""",
    "m_pause": """SELECT session_id, 'engagement_drop_' || row_number() OVER (PARTITION BY session_id ORDER BY seq) marker_id,
        'engagement_drop' "type", round(prev_end_ms / 1000, 3) time_sec, speaker, CASE WHEN gap_ms >= 6000 THEN 'high' ELSE 'medium' END severity,
        round(prev_end_ms / 1000, 3) start_sec, round(start_ms / 1000, 3) end_sec,
        'Long pause of ' || printf('%.2f', gap_ms / 1000) || 's may indicate disengagement or response hesitation.' reason FROM s WHERE gap_ms >= 3000""",
    "m_interruption": """SELECT session_id, 'interruption_' || row_number() OVER (PARTITION BY session_id ORDER BY seq) marker_id,
        'interruption' "type", round(start_ms / 1000, 3) time_sec, speaker, 'medium' severity, round(start_ms / 1000, 3) start_sec,
        round(end_ms / 1000, 3) end_sec, speaker || ' begins before ' || prev_speaker || ' finished speaking.' reason FROM s WHERE interrupts""",
    "m_shift": """SELECT session_id, 'emotional_shift_' || row_number() OVER (PARTITION BY session_id ORDER BY seq) marker_id,
        'emotional_shift' "type", round(start_ms / 1000, 3) time_sec, speaker,
        CASE WHEN abs(score_e4 - own_score) >= 7000 THEN 'high' ELSE 'medium' END severity, round(own_start / 1000, 3) start_sec,
        round(end_ms / 1000, 3) end_sec, speaker || ' shows a notable sentiment shift between turns.' reason FROM (SELECT *, lag(score_e4) OVER o own_score, lag(start_ms) OVER o own_start FROM s
          WINDOW o AS (PARTITION BY session_id, speaker ORDER BY start_ms, end_ms, utt_id)) WHERE abs(score_e4 - own_score) >= 4500""",
    "m_decline": """SELECT session_id, 'session_tone_decline' marker_id, 'session_tone_decline' "type", round(start_ms / 1000, 3) time_sec,
        speaker, 'medium' severity, round(start_ms / 1000, 3) start_sec, round(end_ms / 1000, 3) end_sec,
        'Session sentiment begins a noticeable downward shift.' reason FROM
        (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) ix FROM p WHERE score_e4 - prev_score_e4 <= -800)
        JOIN trend USING (session_id) WHERE ix = 1 AND direction = 'declining'""",
    "m": " UNION ALL ".join(f"SELECT * FROM m_{k}" for k in ("dominance", "tension", "pause", "interruption", "shift", "decline")),
    "cl": """SELECT session_id, time_sec start_sec, third end_sec, coalesce(speaker, s2, s3) primary_speaker, round(third - time_sec, 3) window_span_sec
        FROM (SELECT *, lead(time_sec, 2) OVER o third, lead(speaker) OVER o s2, lead(speaker, 2) OVER o s3 FROM m
          WHERE "type" IN ('high_tension', 'emotional_shift', 'interruption', 'engagement_drop')
          WINDOW o AS (PARTITION BY session_id ORDER BY time_sec, marker_id)) WHERE round(third - time_sec, 3) <= 45""",
    "es": f"""SELECT session_id, 1 place, 'declining_session_trend' signal_type,
          CASE WHEN least(0.30, 0.12 + abs(slope)) >= 0.22 THEN 'high' ELSE 'medium' END severity,
          round(least(0.30, 0.12 + abs(slope)), 4) score, NULL::VARCHAR speaker FROM trend WHERE direction = 'declining'
        UNION ALL SELECT session_id, 2, 'negative_sentiment_density', CASE WHEN negative_count / sample_count >= 0.30 THEN 'high' ELSE 'medium' END,
          round(least(0.25, 0.10 + negative_count / sample_count), 4), NULL FROM sent WHERE negative_count / sample_count >= 0.15
        UNION ALL SELECT session_id, 3, 'speaker_emotional_strain', CASE WHEN strain >= 0.20 THEN 'high' ELSE 'medium' END, round(strain, 4), speaker FROM
          (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY strain DESC, first_seq) ix FROM
            (SELECT session_id, speaker, least(0.25, 0.08 + dominant_share * 0.25) strain, first_seq FROM emo_sp JOIN sp USING (session_id, speaker)
             WHERE list_contains({_list(words.NEGATIVE_EMOTIONS)}, dominant_emotion))) WHERE ix = 1
        UNION ALL SELECT session_id, 4, 'turn_tension', CASE WHEN least(0.30, events / n) >= 0.20 THEN 'high' ELSE 'medium' END,
          round(least(0.30, events / n), 4), NULL FROM (SELECT session_id, sum(interruption_count + overlap_count) events, sum(utterance_count) n
          FROM sp GROUP BY 1) WHERE events > 0
        UNION ALL SELECT session_id, 5, 'marker_cluster_density', CASE WHEN least(0.25, 0.08::DOUBLE * count(*)) >= 0.20 THEN 'high' ELSE 'medium' END,
          round(least(0.25, 0.08::DOUBLE * count(*)), 4), NULL FROM cl GROUP BY session_id""",
    "esc": _assessment("es", "Escalation", "No clear escalation pattern was detected.", [(0.70, "severe"), (0.45, "moderate"), (0.20, "mild")]),
    "r": f"""SELECT * EXCLUDE (tokens, padded, total), CASE WHEN total > 0 THEN 'positive' WHEN total < 0 THEN 'negative' END lexical,
        CASE WHEN {_says(words.DENIALS)} THEN 'deny' WHEN {_says(words.AFFIRMATIONS)} THEN 'affirm' END stance,
        CASE WHEN list_contains({_list(words.NEGATIVE_EMOTIONS)}, lower(emotion_top)) THEN 'negative'
          WHEN list_contains({_list(words.POSITIVE_EMOTIONS)}, lower(emotion_top)) THEN 'positive'
          WHEN list_contains({_list(words.NEUTRAL_EMOTIONS)}, lower(emotion_top)) THEN 'neutral' END emotion_side FROM
        (SELECT *, ' ' || array_to_string(tokens, ' ') || ' ' padded, coalesce(list_sum(list_transform(tokens, lambda t, i:
           CASE WHEN {_turned} THEN -1 ELSE 1 END * ({_kind}))), 0) total FROM
          (SELECT *, {_tokens} tokens, CASE WHEN v2 > v1 THEN e2 ELSE e1 END emotion_top FROM s))""",
    "h": f"""SELECT session_id, 1 family, seq, speaker, start_ms from_ms, end_ms, lexical <> sent_label hit,
          'Sentiment label ''' || sent_label || ''' disagrees with lexical tone ''' || lexical || ''' in this turn.' reason FROM r
          WHERE sent_label IN ('positive', 'negative') AND lexical IS NOT NULL
        UNION ALL SELECT session_id, 2, seq, speaker, start_ms, end_ms, (sent_label = 'positive' AND emotion_side = 'negative')
          OR (sent_label = 'negative' AND emotion_side = 'positive'), 'Sentiment ''' || sent_label || ''' conflicts with dominant emotion ''' || emotion_top || ''' on this turn.' FROM r WHERE sent_label IN ('positive', 'negative') AND emotion_side IS NOT NULL
        UNION ALL {_turnaround(3, "emotion_side IN ('positive', 'negative')", "emotion_side", 30000, "flips emotion", "emotion_top")}
        UNION ALL {_turnaround(4, "stance IS NOT NULL", "stance", 60000, "switches stance", "stance")}
        UNION ALL SELECT session_id, 5, seq, speaker, start_ms, end_ms, true,
          speaker || ' delivers negative content with a flat / ''' || emotion_top || ''' emotional tone.' FROM r WHERE lower(emotion_top) IN ('neutral', 'calm')
          AND (lexical = 'negative' OR sent_label = 'negative')""",
    "is_": """SELECT session_id, family place, ['sentiment_text_mismatch', 'sentiment_emotion_contradiction', 'abrupt_emotional_reversal',
          'contradictory_statements', 'masking_tone'][family] signal_type,
        CASE WHEN raw >= [0.18, 0.16, 0.18, 0.14, 0.14][family] THEN 'medium' ELSE 'low' END severity, round(raw, 4) score, speaker, hits, eligible FROM
        (SELECT *, CASE WHEN family = 1 AND (hits >= 2 OR hits / eligible >= 0.5) THEN least(0.30::DOUBLE, 0.08::DOUBLE + hits / eligible * 0.40::DOUBLE)
           WHEN family = 2 AND (hits >= 2 OR hits / eligible >= 0.5) THEN least(0.25::DOUBLE, 0.07::DOUBLE + hits / eligible * 0.35::DOUBLE)
           WHEN family = 3 THEN least(0.25::DOUBLE, 0.10::DOUBLE + hits * 0.08::DOUBLE) WHEN family = 4 THEN least(0.20::DOUBLE, 0.08::DOUBLE + hits * 0.06::DOUBLE)
           WHEN family = 5 AND hits >= 2 THEN least(0.20::DOUBLE, 0.07::DOUBLE + hits * 0.05::DOUBLE) END raw
         FROM (SELECT session_id, family, count_if(hit)::BIGINT hits, count(*) eligible FROM h GROUP BY ALL) WHERE hits > 0)
        JOIN (SELECT session_id, family, arg_max(speaker, (n, -first)) speaker FROM (SELECT session_id, family, speaker, count(*) n, min(seq) first
              FROM h WHERE hit GROUP BY ALL) GROUP BY ALL) USING (session_id, family) WHERE raw IS NOT NULL""",
    "iw": """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY family, ix) number, signal_type, severity "level", h5.speaker,
        round(from_ms / 1000, 3) start_sec, round(end_ms / 1000, 3) end_sec, reason FROM
        (SELECT *, row_number() OVER (PARTITION BY session_id, family ORDER BY seq) ix FROM h WHERE hit) h5
        JOIN is_ ON is_.session_id = h5.session_id AND is_.place = h5.family WHERE ix <= 5""".replace("SELECT session_id, row_number() OVER (PARTITION BY session_id", "SELECT h5.session_id, row_number() OVER (PARTITION BY h5.session_id"),
    "inc": _assessment("is_", "Inconsistency", "No clear inconsistency pattern was detected.", [(0.65, "high"), (0.40, "medium"), (0.15, "low")]),
    "tl": """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_sec, marker_id) place FROM (SELECT * FROM m UNION ALL
        SELECT session_id, 'inconsistency_' || number, 'inconsistency_candidate', start_sec, iw.speaker, iw."level", start_sec, end_sec, iw.reason
        FROM iw JOIN inc USING (session_id) WHERE inc."level" <> 'none')""",
    "sc": """SELECT session_id, dominance_score, engagement_score, conflict_score,
        greatest(0.0, least(1.0, printf('%.4f', (1.0::DOUBLE - dominance_score) * 0.35::DOUBLE + (1.0::DOUBLE - conflict_score) * 0.40::DOUBLE
          + engagement_score * 0.25::DOUBLE)::DOUBLE)) cooperation_score, emotion_volatility_score, pause_part, question_part, trend_part FROM
        (SELECT *, greatest(0.0, least(1.0, printf('%.4f', 0.7::DOUBLE * pause_part + 0.3::DOUBLE * question_part + trend_part)::DOUBLE)) engagement_score FROM
          (SELECT session_id, greatest(0.0, least(1.0, round(dominance, 4))) dominance_score,
             greatest(0.0, least(1.0, printf('%.4f', events::DOUBLE / total_utterances)::DOUBLE)) conflict_score, emotion_volatility emotion_volatility_score,
             1.0::DOUBLE - least(avg_pause_sec / 5.0::DOUBLE, 1.0) pause_part, least(total_questions / total_utterances, 1.0) question_part,
             CASE direction WHEN 'improving' THEN 0.05::DOUBLE WHEN 'declining' THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END trend_part
           FROM sm JOIN (SELECT session_id, max(speaking_ratio) dominance, sum(interruption_count + overlap_count) events FROM sp GROUP BY 1) USING (session_id)
           LEFT JOIN trend USING (session_id) LEFT JOIN vol USING (session_id)))""",
    "sf": """SELECT session_id, speaker, "type", severity, reason FROM (
        SELECT session_id, speaker, 'frequent_interruptions' "type", 'medium' severity, speaker || ' shows repeated interruption behavior.' reason FROM sp WHERE interruption_count >= 2
        UNION ALL SELECT session_id, speaker, 'high_overlap_participation', 'medium', speaker || ' is frequently involved in overlapping turns.' FROM sp WHERE overlap_count >= 2
        UNION ALL SELECT session_id, speaker, 'low_inquiry_behavior', 'low', speaker || ' asks very few or no questions.' FROM sp WHERE question_count = 0 AND utterance_count >= 4
        UNION ALL SELECT session_id, speaker, 'speaker_emotional_strain', 'low', speaker || ' shows repeated ' || dominant_emotion || ' emotional signals.'
          FROM sp JOIN emo_sp USING (session_id, speaker) WHERE dominant_emotion IN ('angry', 'frustrated', 'anxious', 'upset') AND sample_count >= 2)""",
    "ff": """SELECT session_id, speaker, "type", severity, reason FROM (
        SELECT session_id, speaker, 'speaker_dominance' "type", severity, speaker || ' appears to dominate the conversation.' reason FROM m_dominance
        UNION ALL SELECT session_id, speaker, 'high_tension', severity, speaker || ' is involved in repeated interruptions or overlaps, which may indicate elevated conversational tension.' FROM m_tension
        UNION ALL SELECT session_id, NULL, 'negative_session_mood', 'medium', 'The session shows a strongly negative overall sentiment pattern.' FROM sent WHERE label = 'negative' AND avg_score <= 0.35
        UNION ALL SELECT session_id, NULL, 'declining_session_tone', 'low', 'Session sentiment trends downward across the interaction.' FROM trend WHERE direction = 'declining'
        UNION ALL SELECT session_id, NULL, 'conversation_escalation', CASE "level" WHEN 'mild' THEN 'low' WHEN 'moderate' THEN 'medium' ELSE 'high' END, summary FROM esc WHERE "level" <> 'none'
        UNION ALL SELECT session_id, NULL, 'conversation_inconsistency', "level", summary FROM inc WHERE "level" <> 'none')""",
}

#: What each part reads.
NEEDS: dict[str, str] = {
    "s": "", "sm": "s", "sp": "s", "dominant": "sp", "sent": "s", "sent_sp": "s", "emo": "s", "emo_sp": "s", "p": "s", "trend": "p",
    "vol": "s p", "m_dominance": "sp", "m_tension": "sp", "m_pause": "s", "m_interruption": "s", "m_shift": "s", "m_decline": "p trend",
    "m": "m_dominance m_tension m_pause m_interruption m_shift m_decline", "cl": "m", "es": "trend sent emo_sp sp cl", "esc": "es dominant",
    "r": "s", "h": "r", "is_": "h", "iw": "h is_", "inc": "is_ dominant", "tl": "m iw inc", "sc": "sm sp trend vol", "sf": "sp emo_sp",
    "ff": "m_dominance m_tension sent trend esc inc",
}


def sql(select: str, *parts: str, first: str = UTTERANCES_SQL) -> str:
    """``select`` over the named parts and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, "").split():
            add(other)
        if name not in order:
            order.append(name)

    for part in parts:
        add(part)
    made = ", ".join([first, *[f"{name} AS MATERIALIZED ({PARTS[name]})" for name in order]])
    return f"WITH {made} {select}"


ORACLES: dict[str, str] = {
    "utterances": sql("SELECT session_id, utt_id, pos, speaker, start_ms, end_ms, text, sent_label, score_e4, overlap FROM u"),
    "session_metrics": sql("SELECT * FROM sm", "sm"),
    "speaker_metrics": sql("SELECT * EXCLUDE (first_seq) FROM sp", "sp"),
    "pauses": sql(
        "SELECT session_id, prev_utt_id start_after_utterance_id, utt_id end_before_utterance_id, round(gap_ms / 1000, 3) duration_sec, "
        "prev_speaker speaker_before, speaker speaker_after FROM s WHERE gap_ms > 0",
        "s",
    ),
    "dominant_speaker": sql("SELECT * FROM dominant", "dominant"),
    "session_sentiment": sql("SELECT * FROM sent", "sent"),
    "speaker_sentiment": sql("SELECT * FROM sent_sp", "sent_sp"),
    "emotion_distribution": sql("SELECT session_id, emotion, share, dominant, sample_count FROM emo", "emo"),
    "speaker_emotion": sql("SELECT * FROM emo_sp", "emo_sp"),
    "sentiment_trend": sql("SELECT * FROM trend", "trend"),
    "emotion_volatility": sql("SELECT * FROM vol", "vol"),
    **{
        f"{k}_markers": sql(f"SELECT * FROM m_{k}", f"m_{k}")
        for k in ("dominance", "tension", "pause", "interruption", "shift", "decline")
    },
    "timeline": sql("SELECT * FROM tl", "tl"),
    "marker_clusters": sql("SELECT * FROM cl", "cl"),
    "escalation_signals": sql("SELECT * FROM es", "es"),
    "escalation": sql("SELECT * FROM esc", "esc"),
    "read_turns": sql("SELECT session_id, utt_id, lexical, stance, emotion_top, emotion_side FROM r", "r"),
    "inconsistent_turns": sql("SELECT session_id, family, seq, speaker, hit FROM h", "h"),
    "inconsistency_signals": sql("SELECT * FROM is_", "is_"),
    "inconsistency_windows": sql("SELECT * FROM iw", "iw"),
    "inconsistency": sql("SELECT * FROM inc", "inc"),
    "scores": sql("SELECT * FROM sc", "sc"),
    "score_breakdown": sql(
        "SELECT session_id, i.score, i.component, i.weight, printf('%.3f', i.value)::DOUBLE value, i.reason FROM (SELECT session_id, unnest(["
        + ", ".join(
            f"{{'score': '{s}', 'component': '{c}', 'weight': {w}::DOUBLE, 'value': {v}, 'reason': '{r}'}}"
            for s, c, w, v, r in (
                ("dominance_score", "max_speaking_ratio", 1.0, "dominance_score", "Higher concentration of speaking time increases dominance score."),
                ("engagement_score", "pause_behavior", 0.7, "pause_part", "Shorter pauses and steadier turn flow improve engagement."),
                ("engagement_score", "question_behavior", 0.3, "question_part", "More clarifying questions can indicate active engagement."),
                ("engagement_score", "sentiment_trend_adjustment", 0.05, "trend_part", "Sentiment trend slightly adjusts engagement score."),
                ("conflict_score", "interruptions_and_overlaps", 1.0, "conflict_score", "More interruptions and overlaps increase conflict score."),
                ("cooperation_score", "balance_and_low_conflict", 1.0, "cooperation_score", "Balanced participation with low conflict improves cooperation."),
                ("emotion_volatility_score", "aggregated_signal_variation", 1.0, "emotion_volatility_score", "Higher sentiment swings and more emotion switching increase volatility."),
            )
        )
        + "]) i FROM sc)",
        "sc",
    ),
    "speaker_flags": sql("SELECT * FROM sf", "sf"),
    "session_flags": sql("SELECT * FROM ff", "ff"),
}
