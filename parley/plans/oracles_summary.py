"""SQL with the results of the texts about a session and of the whole bundle."""

from __future__ import annotations

from parley.plans.oracles import sql

_OVERALL = """SELECT session_id, concat_ws(' ',
  'This session contains ' || total_utterances || ' utterances across ' || total_speakers || ' speaker(s), with a total measured speaking time of '
    || printf('%.2f', total_duration_sec) || ' seconds and ' || total_words || ' words.',
  'Overall sentiment appears ' || sent.label || ' with a ' || direction || ' trend (average score ' || printf('%.2f', avg_score) || ').',
  'Emotion signals are led by ' || emo.emotion || ' across the session.',
  'The interaction appears ' || CASE WHEN speaking_ratio >= 0.75 THEN 'highly imbalanced' WHEN speaking_ratio >= 0.6 THEN 'somewhat imbalanced'
    ELSE 'fairly balanced' END || ', with ' || dominant_speaker || ' contributing the largest share of speaking time.',
  'Overall engagement appears ' || CASE WHEN conflict_score >= 0.7 THEN 'strained' WHEN engagement_score >= 0.7 AND conflict_score < 0.3
    THEN 'active and reasonably cooperative' WHEN engagement_score < 0.35 THEN 'low-energy' ELSE 'moderately engaged' END
    || ', and pause behavior suggests ' || CASE WHEN max_pause_sec >= 6 THEN 'some substantial hesitation or disengagement windows'
    WHEN avg_pause_sec >= 3 THEN 'noticeable pauses between responses' WHEN avg_pause_sec <= 1 THEN 'a relatively smooth response flow'
    ELSE 'occasional pauses but generally steady pacing' END || '.',
  CASE WHEN conflict_score >= 0.7 THEN 'Turn-taking behavior suggests elevated tension, with frequent interruptions or overlaps.'
    WHEN conflict_score >= 0.4 THEN 'There are moderate signs of friction in the turn-taking pattern.'
    ELSE 'Turn-taking appears relatively orderly, with limited conflict signals.' END,
  CASE WHEN esc.level <> 'none' THEN 'Escalation assessment is ' || esc.level || ', with score ' || printf('%.2f', esc.score) || '. ' || esc.summary END,
  CASE WHEN inc.level <> 'none' THEN 'Inconsistency assessment is ' || inc.level || ', with score ' || printf('%.2f', inc.score) || '. ' || inc.summary END,
  CASE WHEN high > 0 THEN 'There are ' || high || ' high-severity concern(s) that may deserve closer review.'
    WHEN medium > 0 THEN 'There are ' || medium || ' medium-severity signal(s) worth monitoring.'
    ELSE 'No major high-severity conversational risks were detected.' END) summary
  FROM sm JOIN sc USING (session_id) JOIN dominant USING (session_id) LEFT JOIN sent USING (session_id) LEFT JOIN trend USING (session_id)
  LEFT JOIN (SELECT * FROM emo WHERE dominant) emo USING (session_id) LEFT JOIN esc USING (session_id) LEFT JOIN inc USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) FILTER (severity = 'high') high, count(*) FILTER (severity = 'medium') medium FROM ff GROUP BY 1) c
    USING (session_id)"""
_OVERALL_PARTS = ("sm", "sc", "dominant", "sent", "trend", "emo", "esc", "inc", "ff")
#: Places of the flags in their fixed order.
SPEAKER_FLAG = "list_position(['frequent_interruptions', 'high_overlap_participation', 'low_inquiry_behavior', 'speaker_emotional_strain'], \"type\")"
_SESSION_FLAG = "list_position(['negative_session_mood', 'declining_session_tone', 'conversation_escalation', 'conversation_inconsistency'], \"type\")"
_FLAG_ORDER = f"""CASE WHEN speaker IS NULL THEN 1000000 + {_SESSION_FLAG}
  ELSE first_seq * 10 + list_position(['speaker_dominance', 'high_tension'], "type") END"""

ORACLES: dict[str, str] = {
    "overall_summary": sql(_OVERALL, *_OVERALL_PARTS),
    "speaker_summaries": sql(
        f"""SELECT session_id, speaker, concat_ws(' ', speaker || ' contributed ' || utterance_count || ' utterances, ' || word_count || ' words, and '
          || printf('%.2f', speaking_time_sec) || ' seconds of speech.',
        'Their speaking share was ' || printf('%.2f%%', speaking_ratio * 100) || ', suggesting ' || CASE WHEN speaking_ratio >= 0.6 THEN 'dominant'
          WHEN speaking_ratio <= 0.2 THEN 'limited' ELSE 'moderately active' END || ' participation.',
        CASE WHEN question_count = 0 THEN 'They did not ask questions during the captured interaction.'
          WHEN question_count / utterance_count >= 0.4 THEN 'They used questions frequently, suggesting active probing or clarification.'
          WHEN question_count / utterance_count >= 0.15 THEN 'They asked occasional questions during the conversation.'
          ELSE 'They asked only a small number of questions.' END,
        'Their sentiment profile appears mostly ' || label || '.', 'Their dominant emotional signal is ' || dominant_emotion || '.',
        CASE WHEN interruption_count > 0 THEN 'They were associated with ' || interruption_count || ' interruption event(s).' END,
        CASE WHEN overlap_count > 0 THEN 'They were involved in ' || overlap_count || ' overlapping turn(s).' END,
        coalesce('Notable speaker-level signals include: ' || named || '.', 'No major speaker-level concerns were flagged.')) summary
        FROM sp LEFT JOIN sent_sp USING (session_id, speaker) LEFT JOIN emo_sp USING (session_id, speaker) LEFT JOIN
          (SELECT session_id, speaker, array_to_string(list("type" ORDER BY {SPEAKER_FLAG})[1:3], ', ') named FROM sf GROUP BY ALL) USING (session_id, speaker)""",
        "sp", "sent_sp", "emo_sp", "sf",
    ),
    "session_insights": sql(
        f"""SELECT sm.*, sc.* EXCLUDE (session_id), dominant_speaker, sent.label sentiment, avg_score sentiment_score, direction trend, slope trend_slope,
        emo.emotion, esc.level escalation_level, esc.score escalation_score, esc.primary_speaker escalation_primary_speaker, esc.summary escalation_summary,
        inc.level inconsistency_level, inc.score inconsistency_score, inc.primary_speaker inconsistency_primary_speaker, inc.summary inconsistency_summary,
        ov.summary, speakers, timeline, flags, speaker_flags
        FROM sm JOIN sc USING (session_id) JOIN dominant USING (session_id) LEFT JOIN sent USING (session_id) LEFT JOIN trend USING (session_id)
        LEFT JOIN (SELECT * FROM emo WHERE dominant) emo USING (session_id) LEFT JOIN esc USING (session_id) LEFT JOIN inc USING (session_id)
        LEFT JOIN ({_OVERALL}) ov USING (session_id)
        LEFT JOIN (SELECT session_id, string_agg(speaker, ',' ORDER BY first_seq) speakers FROM sp GROUP BY 1) USING (session_id)
        LEFT JOIN (SELECT session_id, string_agg(marker_id, ',' ORDER BY place) timeline FROM tl GROUP BY 1) USING (session_id)
        LEFT JOIN (SELECT session_id, string_agg("type", ',' ORDER BY {_FLAG_ORDER}) flags FROM ff LEFT JOIN sp USING (session_id, speaker)
          GROUP BY 1) USING (session_id)
        LEFT JOIN (SELECT session_id, string_agg("type", ',' ORDER BY speaker, {SPEAKER_FLAG}) speaker_flags FROM sf GROUP BY 1) USING (session_id)""",
        *_OVERALL_PARTS, "sp", "tl", "sf",
    ),
}
