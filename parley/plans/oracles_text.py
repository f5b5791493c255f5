"""SQL for the queries that read texts: language rules, claims and recommendations."""

from __future__ import annotations

from parley.operators import claims as c
from parley.operators import language as lang
from parley.operators import recommend as rec
from parley.plans.queries import EVIDENCE
from parley.sources.adapters import UTTERANCES_SQL


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(p)})" for p in phrases) + ")"


def _words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> ''))"


def _first(text: str, *patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {_q(p)}, 1), '')" for p in patterns) + ")"


def _on_u(select: str, *more: str) -> str:
    return f"WITH {', '.join([UTTERANCES_SQL, *more])} {select}"


_clean = "trim(coalesce(text, ''))"
for _pattern, _to, _flags in (
    (r"[^A-Za-z0-9\s.,!?;:''\"-]", " ", "g"),
    (r"https?://\S+|www\.\S+", "", "g"),
    (r"\b(uh|um|hmm|erm|ahh|mm)\b", "", "gi"),
    (r"\s+", " ", "g"),
):
    _clean = f"regexp_replace({_clean}, '{_pattern}', '{_to}', '{_flags}')"
for _digit in "0123456789":  # nothing else stands three times in a row in these texts
    _clean = f"regexp_replace({_clean}, '{_digit}{{3,}}', '{_digit * 2}', 'g')"
_clean = f"trim({_clean})"

_emotion = (
    "CASE "
    + " ".join(f"WHEN {_any('lower(text)', ps)} THEN '{e}'" for e, ps in lang.EMOTION_WORDS)
    + " WHEN sent_label = 'positive' THEN 'happy' WHEN sent_label = 'negative' THEN 'sad' ELSE 'neutral' END"
)
_intent = (
    "CASE WHEN t = '' THEN 'other' WHEN "
    + " OR ".join(f"starts_with(t, '{g}')" for g in lang.GREETINGS)
    + f" THEN 'greeting' WHEN {_any('t', lang.QUESTION_PHRASES)} THEN 'question' "
    + " ".join(f"WHEN {_any('t', ps)} THEN '{i}'" for i, ps in lang.INTENT_PHRASES)
    + f" WHEN {_words('t')} > 5 THEN 'information_sharing' ELSE 'other' END"
)
INTENTS = f"i AS (SELECT session_id, utt_id, {_intent} intent FROM (SELECT *, trim(lower(text)) t FROM u))"
TERMS = r"""tw AS (SELECT session_id, utt_id, term, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY session_id, utt_id)), 6) weight FROM
  (SELECT session_id, utt_id, term, count(*) n FROM (SELECT session_id, utt_id, unnest(regexp_extract_all(lower(text), '\b\w\w+\b')) term FROM u)
   GROUP BY ALL))"""


def _group(kind: str, names: list[str], name: str) -> str:
    """A named group, by DuckDB's list of names; one claim in a text."""
    flags = "" if kind in ("WEATHER", "STATIC_FACT") else ", 'i'"
    plain = dict(c.PATTERNS)[kind].replace("(?i)", "")
    for n in names:
        plain = plain.replace(f"(?P<{n}>", "(")
    return f"regexp_extract(text, {_q(plain)}, {names.index(name) + 1 if name else 0}{flags})"


def _case(name: str, table: dict[str, str]) -> str:
    return f"CASE lower({name}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _kind(kind: str, names: list[str], subject: str, value: str, text: str) -> str:
    hit = _group(kind, names, names[0])
    return f"SELECT session_id, utt_id, start_ms claim_ms, '{kind}' claim_type, {subject} subject, {value} \"value\", {text} value_text, {_group(kind, names, '')} claim_text, text FROM u WHERE {hit} <> ''"


def _num(kind: str, names: list[str]) -> str:
    return f"TRY_CAST(replace({_group(kind, names, 'value')}, ',', '') AS DOUBLE)"


_fx, _cr, _st = ["base", "quote", "value"], ["asset", "value"], ["symbol", "value"]
_we, _co, _fa = ["city", "value", "unit"], ["commodity", "value"], ["country", "capital"]
CLAIMS = "cl AS (" + " UNION ALL ".join(
    [
        _kind("CURRENCY_RATE", _fx, f"upper({_group('CURRENCY_RATE', _fx, 'base')}) || '/' || upper({_group('CURRENCY_RATE', _fx, 'quote')})",
              _num("CURRENCY_RATE", _fx), "NULL"),
        _kind("CRYPTO_PRICE", _cr, _case(_group("CRYPTO_PRICE", _cr, "asset"), c.ASSETS), _num("CRYPTO_PRICE", _cr), "NULL"),
        _kind("STOCK_PRICE", _st, f"upper({_group('STOCK_PRICE', _st, 'symbol')})", _num("STOCK_PRICE", _st), "NULL"),
        _kind("WEATHER", _we, f"{_group('WEATHER', _we, 'city')} || '|' || coalesce(nullif(upper({_group('WEATHER', _we, 'unit')}), ''), 'C')",
              _num("WEATHER", _we), "NULL"),
        _kind("COMMODITY_PRICE", _co, _case(_group("COMMODITY_PRICE", _co, "commodity"), c.COMMODITIES), _num("COMMODITY_PRICE", _co), "NULL"),
        _kind("STATIC_FACT", _fa, _group("STATIC_FACT", _fa, "country"), "NULL", _group("STATIC_FACT", _fa, "capital")),
    ]
) + ")"
_known = ", ".join(
    f"('{k}', '{s}', {'NULL' if v is None else v}::DOUBLE, {'NULL' if t is None else _q(t)}, '{src}')" for k, s, v, t, src in EVIDENCE
)
VERDICTS = f"""ev AS (SELECT claim_type, subject, fetched_ms, actual, actual_text, source FROM
    (SELECT DISTINCT start_ms - 20000 fetched_ms FROM u WHERE speaker = 'agent'), (VALUES {_known}) k(claim_type, subject, actual, actual_text, source)),
  aj AS (SELECT cl.*, e.fetched_ms f, CASE WHEN claim_ms - e.fetched_ms <= 60000 THEN e.fetched_ms END fetched_ms,
      e.actual a, e.actual_text at_, e.source s FROM cl ASOF LEFT JOIN ev e ON cl.claim_type = e.claim_type AND cl.subject = e.subject AND cl.claim_ms >= e.fetched_ms),
  aw AS (SELECT session_id, utt_id, claim_ms, claim_type, subject, "value", value_text, claim_text, fetched_ms, CASE WHEN fetched_ms IS NOT NULL THEN a END actual,
      CASE WHEN fetched_ms IS NOT NULL THEN at_ END actual_text, CASE WHEN fetched_ms IS NOT NULL THEN s END source FROM aj),
  ad AS (SELECT *, CASE WHEN claim_type NOT IN ('STATIC_FACT', 'COMMODITY_PRICE') AND actual <> 0 THEN round(abs("value" - actual) / abs(actual) * 100, 2) END diff_pct FROM aw),
  av AS (SELECT *, CASE WHEN claim_type = 'COMMODITY_PRICE' THEN 'UNSUPPORTED_CLAIM_TYPE' WHEN fetched_ms IS NULL THEN 'SOURCE_UNAVAILABLE'
      WHEN claim_type = 'STATIC_FACT' AND value_text <> '' AND actual_text <> '' THEN
        CASE WHEN strip_accents(lower(value_text)) = strip_accents(lower(actual_text)) THEN 'TRUE' ELSE 'FALSE' END
      WHEN diff_pct <= 3 THEN 'TRUE' WHEN diff_pct <= 10 THEN 'PARTIALLY_TRUE' WHEN diff_pct IS NOT NULL THEN 'FALSE' ELSE 'UNVERIFIED' END verdict FROM ad),
  vd AS (SELECT *, round(CASE WHEN verdict = 'TRUE' AND diff_pct IS NULL THEN 1.0 WHEN verdict = 'TRUE' THEN 1.0::DOUBLE - 0.15::DOUBLE * (diff_pct / 3)
      WHEN verdict = 'PARTIALLY_TRUE' THEN 0.65::DOUBLE - 0.20::DOUBLE * ((diff_pct - 3) / 7) WHEN verdict = 'FALSE' AND diff_pct IS NULL THEN 0.95
      WHEN verdict = 'FALSE' THEN 0.70::DOUBLE + 0.25::DOUBLE * least(1.0, (diff_pct - 10) / 20) ELSE 0.0 END, 6)::DOUBLE confidence,
      CASE WHEN verdict IN ('TRUE', 'FALSE') THEN 'HIGH' WHEN verdict = 'PARTIALLY_TRUE' THEN 'MEDIUM' ELSE 'NONE' END confidence_label,
      CASE WHEN verdict = 'UNSUPPORTED_CLAIM_TYPE' THEN 'No source client registered for ' || claim_type || '.'
        WHEN verdict = 'SOURCE_UNAVAILABLE' THEN 'No evidence returned by source client.'
        WHEN claim_type = 'STATIC_FACT' AND verdict = 'UNVERIFIED' THEN 'Missing claimed or actual text for static fact.'
        WHEN claim_type = 'STATIC_FACT' THEN 'Claimed ''' || trim(value_text) || CASE verdict WHEN 'TRUE' THEN ''' matches' ELSE ''' does not match' END
          || ' source value ''' || trim(actual_text) || '''.'
        WHEN "value" IS NULL OR actual IS NULL THEN 'Numeric claim or evidence value is missing.'
        WHEN diff_pct IS NULL THEN 'Source value is zero; relative diff undefined.'
        ELSE 'Diff ' || printf('%.2f', diff_pct) || CASE verdict WHEN 'TRUE' THEN '% within 0-3% band → TRUE.'
          WHEN 'PARTIALLY_TRUE' THEN '% within 3-10% band → PARTIALLY_TRUE.' ELSE '% exceeds 10% threshold → FALSE.' END END reason FROM av)"""

_priority = (
    f"CASE WHEN {_any('lower(text)', rec.CRITICAL_TERMS)} THEN 'CRITICAL' WHEN {_any('lower(text)', rec.HIGH_TERMS)} THEN 'HIGH' ELSE '%s' END"
)
_add = "CASE WHEN %s THEN %s::DOUBLE ELSE 0.0::DOUBLE END"
TASKS = f"""SELECT session_id, 'TASK' action_type, title, CASE WHEN who IS NOT NULL THEN who || ' was assigned to ' || lower(title[1]) || title[2:] || '.'
    ELSE 'A task was identified: ' || title || '.' END description, {_priority % "MEDIUM"} priority,
    round(0.55::DOUBLE + {_add % ("who IS NOT NULL", "0.2")} + {_add % ("due IS NOT NULL", "0.15")}, 4) confidence, utt_id segment_id, who assignee,
    due deadline, NULL::VARCHAR claim_id FROM
    (SELECT *, CASE WHEN cut = '' THEN 'Follow-up task' ELSE upper(cut[1]) || cut[2:] END title FROM
      (SELECT *, trim(trim(regexp_replace(trim(CASE WHEN who IS NOT NULL THEN regexp_replace(text, {_q(rec.LEADING_SUBJECT)}, '') ELSE text END), '[.!?]+$', ''))[1:80]) cut
       FROM (SELECT *, {_first("text", rec.WHO_WILL, rec.ASSIGNED_TO)} who, {_first("text", rec.DATE_PHRASE, rec.BARE_DAY)} due FROM u
             WHERE {_any("lower(text)", rec.TASK_SIGNALS)})))"""
MEETINGS = f"""SELECT session_id, 'CALENDAR' action_type, 'Schedule follow-up call' title, 'The conversation indicates a follow-up call'
    || CASE WHEN dy IS NULL AND clock IS NULL THEN '' ELSE ' ' || concat_ws(' ', dy, 'at ' || clock) END || '.' description, 'HIGH' priority,
    round(0.6::DOUBLE + {_add % ("dy IS NOT NULL", "0.18")} + {_add % ("clock IS NOT NULL", "0.12")}, 4) confidence, utt_id segment_id, NULL::VARCHAR assignee,
    NULL::VARCHAR deadline, NULL::VARCHAR claim_id FROM (SELECT *, {_first("text", rec.DATE_PHRASE, rec.BARE_DAY)} dy, {_first("text", rec.CLOCK)} clock FROM u
    WHERE {_any("lower(text)", rec.MEETING_SIGNALS)})"""
EMAILS = f"""SELECT session_id, 'EMAIL' action_type, 'Send ' || doc title, 'A request to send ' || doc || ' was detected'
    || coalesce(' with deadline ' || due, '') || '.' description, 'HIGH' priority,
    round(0.6::DOUBLE + {_add % (f"doc <> {_q(rec.SOME_DOCUMENT)}", "0.18")} + {_add % ("due IS NOT NULL", "0.12")}, 4) confidence, utt_id segment_id,
    NULL::VARCHAR assignee, NULL::VARCHAR deadline, NULL::VARCHAR claim_id FROM
    (SELECT *, CASE WHEN d = '' OR lower(d) IN ({", ".join(map(_q, rec.NO_DOCUMENT))}) THEN {_q(rec.SOME_DOCUMENT)} ELSE d END doc FROM
      (SELECT *, trim(regexp_extract(text, {_q(rec.DOCUMENT)}, 1)) d, {_first("text", rec.DATE_PHRASE, rec.BARE_DAY)} due FROM u
       WHERE {_any("lower(text)", rec.EMAIL_SIGNALS)}))"""
ESCALATIONS = f"""SELECT session_id, 'SUPPORT' action_type, 'Escalate ' || CASE WHEN contains(lower(text), 'delay') THEN 'delayed ' ELSE '' END
    || CASE WHEN contains(lower(text), 'refund') THEN 'refund' WHEN {_any("lower(text)", ["payment", "billing", "invoice"])} THEN 'billing' ELSE 'service' END || ' issue' title,
    'Potential escalation: ' || upper(why[1]) || why[2:] || ' detected.' description, {_priority % "HIGH"} priority,
    round(0.55::DOUBLE + {_add % ("anger", "0.15")} + {_add % ("complaint OR risk", "0.15")} + 0.0::DOUBLE, 4) confidence, utt_id segment_id,
    NULL::VARCHAR assignee, NULL::VARCHAR deadline, NULL::VARCHAR claim_id FROM
    (SELECT *, concat_ws(', ', CASE WHEN anger THEN 'negative sentiment' END, CASE WHEN complaint THEN 'complaint/delay' END,
       CASE WHEN risk THEN 'explicit risk/escalation cue' END) why FROM
      (SELECT *, {_any("lower(text)", rec.ANGER)} anger, {_any("lower(text)", rec.COMPLAINT)} complaint, {_any("lower(text)", rec.RISK)} risk FROM u)
     WHERE anger OR complaint OR risk)"""

_frame = 16
AUDIO = f"""WITH f AS (SELECT vec_id id, unnest(range(0, len(embedding), {_frame})) s, embedding x FROM embeddings),
  e AS (SELECT id, len(p) n, list_sum(list_transform(p, lambda v: v::DOUBLE * v::DOUBLE)) sq, list_max(list_transform(p, lambda v: abs(v::DOUBLE))) pk
        FROM (SELECT id, x[s + 1:s + {_frame}] p FROM f)),
  d AS (SELECT *, 20 * log10(greatest(sqrt(sq / n), 1e-12)) lv FROM e),
  g AS (SELECT id, sum(n) n, sum(sq) sq, max(pk) pk, count(*) frames, count(*) FILTER (lv < -60) silent, avg(sq / n) FILTER (lv >= -35) sp,
        avg(sq / n) FILTER (lv < -35) no FROM d GROUP BY id),
  h AS (SELECT *, 20 * log10(greatest(sqrt(sq / n), 1e-12)) rms, CASE WHEN sp > 0 AND no > 0 THEN 10 * log10(sp / no) END snr FROM g)
  SELECT id, round(n / 1600, 3) duration_sec, round(rms, 3) rms_db, round(20 * log10(greatest(pk, 1e-12)), 3) peak_db, round(silent / frames, 4) silence_ratio,
  round(snr, 3) snr_db, rms <= -60 is_silent, rms > -60 AND rms <= -45 is_near_silent, coalesce(snr < 10, false) low_snr, coalesce(snr < 5, false) very_low_snr FROM h"""

ORACLES: dict[str, str] = {
    "clean_text": _on_u(f"SELECT session_id, utt_id, {_clean} clean FROM u"),
    "gated_sentiment": _on_u(
        f"SELECT session_id, utt_id, CASE WHEN clean = '' OR sent_label IS NULL OR score < CASE WHEN {_words('clean')} < 4 THEN 0.8 "
        "WHEN sent_label = 'neutral' THEN 0.5 ELSE 0.65 END THEN 'neutral' ELSE sent_label END label, "
        "CASE WHEN clean = '' OR sent_label IS NULL THEN 0.0 ELSE score END score "
        f"FROM (SELECT *, {_clean} clean, score_e4 / 10000 score FROM u)"
    ),
    "emotion_of_text": _on_u(f"SELECT session_id, utt_id, {_emotion} emotion FROM u"),
    "intents": _on_u("SELECT * FROM i", INTENTS),
    "intent_counts": _on_u("SELECT session_id, intent, count(*) n FROM i GROUP BY ALL", INTENTS),
    "cues": _on_u(
        f"SELECT session_id, utt_id, speaker, 'hesitation' \"type\", 0.6::DOUBLE score FROM u WHERE {_any('lower(text)', lang.HESITATION)} "
        f"UNION ALL SELECT session_id, utt_id, speaker, 'aggression', 0.7 FROM u WHERE {_any('lower(text)', lang.AGGRESSION)} "
        f"UNION ALL SELECT session_id, utt_id, speaker, 'lie_risk', 0.5 FROM u WHERE {_any('lower(text)', lang.CERTAINTY)} AND {_any('lower(text)', lang.HEDGES)}"
    ),
    "candidates": _on_u(
        "SELECT session_id, utt_id, (unnest(range(len(c))))::BIGINT place, unnest(c).t \"type\", unnest(c).v \"value\", 'TO_VERIFY' status FROM (SELECT *, "
        "list_concat(list_transform(regexp_extract_all(text, '(?i)\\bhttps?://[^\\s]+'), lambda v: {'t': 'url', 'v': v}), "
        "list_transform(regexp_extract_all(text, '\\b\\d+\\b'), lambda v: {'t': 'number', 'v': v})) c FROM u)"
    ),
    "sentiment_shares": _on_u(
        "SELECT session_id, sent_label, count(*) n, round(count(*) / sum(count(*)) OVER (PARTITION BY session_id), 4) share FROM u "
        "WHERE sent_label IS NOT NULL GROUP BY session_id, sent_label"
    ),
    "emotion_shares": _on_u(
        "SELECT session_id, speaker, "
        + ", ".join(f"round(count(*) FILTER (e = '{e}') / count(*), 4) {e}" for e in lang.BASIC_EMOTIONS)
        + f" FROM (SELECT *, {_emotion} e FROM u) GROUP BY ALL"
    ),
    "term_weights": _on_u("SELECT * FROM tw", TERMS),
    "top_keywords": _on_u(
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, utt_id ORDER BY weight DESC, term) place FROM tw) WHERE place <= 5", TERMS
    ),
    "top_emotion": _on_u(
        "SELECT session_id, utt_id, CASE WHEN e1 IS NULL THEN 'unknown' WHEN v2 > v1 THEN e2 ELSE e1 END topic, "
        "CASE WHEN e1 IS NULL THEN 0.0::DOUBLE ELSE greatest(v1, v2) / 100 END confidence FROM u"
    ),
    "broken_words": "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(\\S{40})', '\\1 ', 'g'), '(\\S{40}) (\\s|$)', '\\1\\2', 'g')) broken FROM documents",
    "audio_quality": AUDIO,
    "claims": _on_u(
        "SELECT session_id, utt_id, claim_ms, instr(text, claim_text) - 1 \"start\", instr(text, claim_text) - 1 + length(claim_text) \"end\", claim_type, claim_text, "
        "subject, \"value\", value_text, 'claim_1' claim_id, claim_type || '|' || subject signature FROM cl",
        CLAIMS,
    ),
    "review_recommendations": _on_u(
        "SELECT session_id, 'FACT_CHECK' action_type, 'Review ' || word || ' claim' title, 'The claim \"' || trim(claim_text) || '\" is ' || word || "
        "' and should be reviewed manually.' description, CASE WHEN word = 'false' THEN 'CRITICAL' ELSE 'HIGH' END priority, "
        "least(1.0, round(base + CASE WHEN confidence < 0.7 THEN 0.05::DOUBLE ELSE 0 END, 4)) confidence, NULL::VARCHAR segment_id, NULL::VARCHAR assignee, "
        "NULL::VARCHAR deadline, utt_id || '/claim_1' claim_id FROM (SELECT *, CASE verdict WHEN 'FALSE' THEN 'false' WHEN 'NEEDS_REVIEW' THEN 'flagged' ELSE 'unverified' END word, "
        "CASE verdict WHEN 'FALSE' THEN 0.9::DOUBLE WHEN 'NEEDS_REVIEW' THEN 0.85 ELSE 0.8 END base FROM vd "
        "WHERE verdict IN ('FALSE', 'NEEDS_REVIEW', 'UNVERIFIED', 'UNSUPPORTED_CLAIM_TYPE'))",
        CLAIMS,
        VERDICTS,
    ),
    "final_records": _on_u(
        "SELECT session_id, count(*) n, string_agg(CASE WHEN session_id::BIGINT % 2 = 0 THEN intent ELSE 'other' END, ',' ORDER BY pos) intents, "
        "string_agg(speaker, ',' ORDER BY pos) turns, string_agg(DISTINCT speaker, ',' ORDER BY speaker) speakers FROM u JOIN i USING (session_id, utt_id) GROUP BY 1",
        INTENTS,
    ),
    "claim_stats": _on_u(
        "SELECT session_id, count(*) claims_detected, count(*) FILTER (verdict IN ('TRUE', 'FALSE', 'PARTIALLY_TRUE')) verified, "
        "count(*) FILTER (verdict NOT IN ('TRUE', 'FALSE', 'PARTIALLY_TRUE')) skipped FROM vd GROUP BY 1",
        CLAIMS,
        VERDICTS,
    ),
    "claim_verdicts": _on_u(
        "SELECT session_id, utt_id, claim_ms, claim_type, subject, \"value\", value_text, 'claim_1' claim_id, claim_type || '|' || subject signature, "
        "fetched_ms, actual, actual_text, source, diff_pct, verdict, confidence, confidence_label, reason FROM vd",
        CLAIMS,
        VERDICTS,
    ),
    "task_recommendations": _on_u(TASKS),
    "meeting_recommendations": _on_u(MEETINGS),
    "email_recommendations": _on_u(EMAILS),
    "escalation_recommendations": _on_u(ESCALATIONS),
    "agent_context": _on_u(
        "SELECT session_id, utt_id segment_id, speaker, printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) start_time, "
        "printf('%02d:%02d:%02d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60) end_time, text, confidence FROM u"
    ),
}
