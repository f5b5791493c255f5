import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parley.functions import numbers
from parley.functions import text as rules
from parley.operators import align, claims, distinct, metrics, quality, recommend, timeline
from parley.plans.bundle import build_bundle
from parley.sources.adapters import utterances_from_events
from parley.thresholds import Thresholds

FOLDER = "/root/testdata/sf0.001"
SCHEMA = (
    "session_id string, utt_id string, pos long, speaker string, start_ms long, end_ms long, text string, word_count long, sent_label string, "
    "score_e4 long, emotion map<string,double>, overlap boolean, confidence double"
)


def session(spark, *rows, name="s"):
    """Rows of (speaker, start, end, text) and, if wanted, score and emotions; times in seconds."""
    made = []
    for at, (speaker, start, end, text, *more) in enumerate(rows, 1):
        score = more[0] if more else None
        label = None if score is None else "negative" if score < 0.35 else "positive" if score > 0.65 else "neutral"
        e4 = None if score is None else round(score * 10000)
        made.append((name, f"u{at}", at, speaker, int(start * 1000), int(end * 1000), text, None, label, e4, more[1] if len(more) > 1 else None, False, 0.9))
    return spark.createDataFrame(made, SCHEMA)


def test_metrics_of_a_short_call(spark):
    seq = metrics.sequence(session(spark, ("agent", 0, 2, "Hello there"), ("customer", 2.5, 5, "Can you help me?"), ("agent", 6, 7, "Sure")))
    s = metrics.session_metrics(seq).first()
    assert (s.total_duration_sec, s.total_speakers, s.total_words, s.total_questions, s.total_pauses) == (5.5, 2, 7, 1, 2)
    assert (s.avg_pause_sec, s.max_pause_sec) == (0.75, 1.0)
    by = {r.speaker: r for r in metrics.speaker_metrics(seq).collect()}
    assert (by["agent"].speaking_ratio, by["customer"].speaking_ratio) == (0.5455, 0.4545)
    assert [r.duration_sec for r in metrics.pauses(seq).orderBy("duration_sec").collect()] == [0.5, 1.0]


def test_rounding_by_the_binary_value(spark):
    values = [n / 10000 for n in range(-10000, 10001, 5)] + [random.Random(1).random() for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for digits in (3, 4):
        found = rows.select("v", numbers.round_binary(F.col("v"), digits).alias("r")).collect()
        assert all(r.r == (None if r.v is None else round(r.v, digits)) for r in found)


def test_silent_and_touching_turns(spark):
    seq = metrics.sequence(session(spark, ("a", 1, 1, ""), ("b", 1, 1, "")))
    assert {(r.speaking_ratio, r.word_ratio) for r in metrics.speaker_metrics(seq).collect()} == {(0.0, 0.0)}
    assert metrics.pauses(seq).count() == 0


def test_long_pauses_start_at_three_seconds(spark):
    seq = metrics.sequence(session(spark, ("a", 0, 1, "x"), ("b", 3.5, 4, "y"), ("a", 7, 8, "z"), ("a", 14, 15, "w")))
    found = timeline.pause_markers(seq, Thresholds()).orderBy("time_sec").collect()
    assert [(r.marker_id, r.time_sec, r.severity) for r in found] == [("engagement_drop_1", 4.0, "medium"), ("engagement_drop_2", 8.0, "high")]


def test_polarity_and_stance(spark):
    texts = {
        "I am not happy": ("negative", None), "not a b c happy": ("positive", None), "never bad, no problem": ("positive", "deny"),
        "good and bad": (None, None), "Yes of course": (None, "affirm"), "don't like, it's great": ("negative", None), "": (None, None), "north": (None, None),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("k", rules.tokens(F.col("t")))
    rows = df.select("t", rules.lexical_polarity(F.col("k")).alias("p"), rules.stance(F.col("k")).alias("s")).collect()
    assert {r.t: (r.p, r.s) for r in rows} == texts


def test_an_escalating_call(spark):
    angry, calm = {"angry": 0.8, "calm": 0.2}, {"calm": 0.9, "angry": 0.1}
    rows = [("agent", 0, 4, "All is great", 0.9, calm), ("customer", 3, 6, "This is terrible and broken", 0.1, angry), ("agent", 5, 8, "No, that is wrong", 0.8, calm),
            ("customer", 7, 9, "Yes, I am furious", 0.2, calm), ("agent", 8, 12, "Yes, right", 0.3, angry)]
    b = build_bundle(session(spark, *rows))
    assert b.trend.first().direction == "declining"
    fired = {r.signal_type: r.score for r in b.escalation_signals.collect()}
    assert fired["declining_session_trend"] == 0.3 and fired["negative_sentiment_density"] == 0.25 and fired["turn_tension"] == 0.3
    level = b.escalation.first()
    assert level.level == "severe" and level.score == 1.0
    families = {r.signal_type for r in b.inconsistency_signals.collect()}
    assert {"abrupt_emotional_reversal", "contradictory_statements"} <= families
    assert all(0 <= v <= 1 for k, v in b.scores.first().asDict().items() if k.endswith("_score"))
    assert "conversation_escalation" in {r.type for r in b.session_flags.collect()}


def test_results_do_not_depend_on_partitions_or_order(spark):
    turns = utterances_from_events(spark, FOLDER).persist()
    one = build_bundle(turns.coalesce(1).orderBy("utt_id"))
    expected = (one.scores.collect(), one.escalation.collect(), one.inconsistency.collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        other = build_bundle(turns.orderBy(F.desc("confidence")).repartition(7))
        found = (other.scores.collect(), other.escalation.collect(), other.inconsistency.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [sorted(map(str, x)) for x in found] == [sorted(map(str, x)) for x in expected]


def test_claims_in_one_text(spark):
    text = "Bitcoin price is 95,5 and USD to PKR is 280. EUR/EUR 1. weather in New York 18 F; gold costs 2400; capital of France is Paris"
    found = claims.detect_claims(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string"), ["id"]).orderBy("start").collect()
    assert [(r.claim_id, r.claim_type, r.subject, r.value, r.value_text) for r in found] == [
        ("claim_1", "CRYPTO_PRICE", "BTC", 955.0, None), ("claim_2", "CURRENCY_RATE", "USD/PKR", 280.0, None),
        ("claim_3", "WEATHER", "New York|F", 18.0, None), ("claim_4", "COMMODITY_PRICE", "XAU", 2400.0, None),
        ("claim_5", "STATIC_FACT", "France", None, "Paris"),
    ]
    assert all(text[r.start : r.end] == r.claim_text for r in found)


def test_evidence_is_the_last_before_and_fresh(spark):
    rows = [(t, "CRYPTO_PRICE", "BTC", 100.0, None) for t in (999, 1000, 3_599_999, 3_600_500, 3_660_000, 3_660_001)]
    asked = spark.createDataFrame(rows, "claim_ms long, claim_type string, subject string, value double, value_text string")
    evidence = claims.evidence_table(spark, [("CRYPTO_PRICE", "BTC", 1000, 100.0, None, "x"), ("CRYPTO_PRICE", "BTC", 3_600_000, 105.0, None, "x")])
    found = {r.claim_ms: r.actual for r in claims.with_evidence(asked, evidence).collect()}
    assert found == {999: None, 1000: 100.0, 3_599_999: None, 3_600_500: 105.0, 3_660_000: 105.0, 3_660_001: None}


def test_verdicts_and_confidence(spark):
    rows = [("CRYPTO_PRICE", 100.0, None, a, None, 1) for a in (100.0, 103.0, 108.0, 200.0, 0.0)]
    rows += [("STATIC_FACT", None, "Bogota", None, "BOGOTÁ", 1), ("STATIC_FACT", None, "Lima", None, "Quito", 1), ("WEATHER", 1.0, None, None, None, None),
             ("COMMODITY_PRICE", 1.0, None, 1.0, None, 1)]
    df = spark.createDataFrame(rows, "claim_type string, value double, value_text string, actual double, actual_text string, fetched_ms long")
    found = [(r.verdict, r.confidence) for r in claims.verdicts(df.coalesce(1)).collect()]
    assert [v for v, _ in found] == ["TRUE", "TRUE", "PARTIALLY_TRUE", "FALSE", "UNVERIFIED", "TRUE", "FALSE", "SOURCE_UNAVAILABLE", "UNSUPPORTED_CLAIM_TYPE"]
    assert found[0][1] == 1.0 and found[3][1] == 0.95 and found[5][1] == 1.0 and found[7][1] == 0.0


def test_recommendations_collapse_and_rank(spark):
    turns = session(
        spark, ("a", 0, 1, "Let's schedule a call next Monday at 2 PM"), ("b", 2, 3, "Yes, schedule a call on Monday"),
        ("a", 4, 5, "John will send the report by Friday, urgent"), ("b", 6, 7, "I want a refund, this is unacceptable"),
    )
    found = recommend.run_recommendations(turns).orderBy("rank").collect()
    assert [r.action_type for r in found].count("CALENDAR") == 1
    task = next(r for r in found if r.action_type == "TASK")
    assert (task.assignee, task.deadline, task.priority) == ("John", "by Friday", "CRITICAL") and found[0].priority == "CRITICAL"
    assert next(r for r in found if r.action_type == "SUPPORT").title == "Escalate refund issue"
    assert recommend.run_recommendations(turns.limit(0)).count() == 0


@pytest.mark.parametrize(("small", "block", "first"), [(1000, 8192, 512), (0, 8192, 512), (20, 3, 2)])
def test_recommendations_match_the_rule_in_plain_python(spark, monkeypatch, small, block, first):
    """Marks and similar titles against the rule written out over all pairs, within tasks and by joins."""
    from difflib import SequenceMatcher

    monkeypatch.setattr(recommend, "SMALL", small)
    monkeypatch.setattr(distinct, "BLOCK", block)
    monkeypatch.setattr(distinct, "FIRST", first)
    monkeypatch.setattr(distinct, "ROUND", 2 * first)
    rng = random.Random(11)
    words = ["send", "the", "report", "reports", "contract", "offer", "to", "Maria", "Marie", "will", "please", "call"]
    rows = [(f"s{i % 4}", f"u{rng.randrange(25)}", i, "please " + " ".join(rng.choices(words, k=5)) + rng.choice(["", " by Friday", " today"]), rng.choice([None, 0.2, 0.9]))
            for i in range(120)]
    turns = spark.createDataFrame(rows, "session_id string, utt_id string, pos long, text string, confidence double").dropDuplicates(["session_id", "utt_id"]).cache()
    candidates = recommend.collect_recommendations(turns).collect()
    heard = {(r.session_id, r.utt_id): (r.pos, r.confidence) for r in turns.collect()}

    def same(x, y):
        close = SequenceMatcher(None, x.title.lower(), y.title.lower()).ratio() >= 0.82
        person = x.assignee and (x.assignee, x.deadline) == (y.assignee, y.deadline)
        return bool(close or person or x.segment_id == y.segment_id)

    expected = set()
    for key in {(r.session_id, r.action_type) for r in candidates}:
        group = sorted((r for r in candidates if (r.session_id, r.action_type) == key), key=lambda r: (heard[r.session_id, r.segment_id][0], r.segment_id))
        scores = []
        for i, r in enumerate(group):
            asr = heard[r.session_id, r.segment_id][1]
            extra = 0.0 if asr is None else max(-0.05, min(0.05, (asr - 0.8) * 0.25))
            again = sum(same(r, o) for j, o in enumerate(group) if j != i)
            scores.append(round(max(0.0, min(1.0, r.confidence + extra + 0.03 * min(2, again))), 4))
        kept = []
        for i in sorted(range(len(group)), key=lambda i: -scores[i]):
            if not any(same(group[i], group[k]) for k in kept):
                kept.append(i)
        expected |= {(*key, group[i].segment_id, scores[i]) for i in kept}
    found = {(r.session_id, r.action_type, r.segment_id, r.confidence) for r in recommend.run_recommendations(turns).collect()}
    assert found == expected and len(found) < len(candidates)


def test_claims_of_two_turns_stay_apart_and_negative_sessions_escalate(spark):
    claims_ = spark.createDataFrame([("s", "u1", "claim_1", "Bitcoin is 5", "FALSE", 0.9), ("s", "u2", "claim_1", "gold costs 7 an ounce today", "UNSUPPORTED_CLAIM_TYPE", 0.0)],
                                    "session_id string, utt_id string, claim_id string, claim_text string, verdict string, confidence double")
    turns = session(spark, ("a", 0, 1, "I want a refund"))
    key = turns.first().session_id
    reviews = [r for r in recommend.run_recommendations(turns, claims_).collect() if r.action_type == "FACT_CHECK"]
    assert {r.claim_id for r in reviews} == {"u1/claim_1", "u2/claim_1"}
    plain, raised = (recommend.run_recommendations(turns, negative=n).first().confidence for n in (None, spark.createDataFrame([(key,)], "session_id string")))
    assert abs(raised - plain - 0.1) < 1e-9
    glued = spark.createDataFrame([(1, "USDtoEUR 1.10")], "id int, text string")
    assert [r.subject for r in claims.detect_claims(glued, ["id"]).collect()] == ["USD/EUR"]


def test_interval_joins_match_the_naive_ones(spark):
    rng = random.Random(3)
    words = [(f"s{rng.randrange(3)}", i, 0, f"w{i}", float(s := rng.randrange(0, 200_000)), float(s + rng.randrange(1, 70_000))) for i in range(80)]
    turns = [(f"s{rng.randrange(3)}", i, "x", s := rng.randrange(0, 200_000), s + rng.randrange(0, 70_000)) for i in range(60)]
    w = spark.createDataFrame(words, "session_id string, seg_pos long, at int, word string, word_start double, word_end double")
    t = spark.createDataFrame(turns, "session_id string, pos long, speaker string, start_ms long, end_ms long")
    t = t.withColumns({"confidence": F.lit(0.5), "diarization_confidence": F.lit(None).cast("double")})
    found = {(r.session_id, r.pos): r.text for r in align.align_words(w, t).collect()}
    expected = {}
    for s, pos, _, a, b in turns:
        hit = [(x[4], x[1], x[3]) for x in words if x[0] == s and x[5] > a and x[4] < b]
        if hit:
            expected[s, pos] = " ".join(x[2] for x in sorted(hit))
    assert found == expected
    windows = [(r.session_id, r.start_ms, r.end_ms) for r in align.overlap_windows(t).collect()]
    naive = []
    for s in ("s0", "s1", "s2"):
        own = [(a, b, p) for n, p, _, a, b in turns if n == s]
        cuts = sorted({(max(x[0], y[0]), min(x[1], y[1])) for x in own for y in own if x < y and min(x[1], y[1]) - max(x[0], y[0]) >= 150})
        merged = []
        for a, b in cuts:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        naive += [(s, a, b) for a, b in merged]
    assert sorted(windows) == sorted(naive)


def test_smoothing_merging_and_turns(spark):
    rows = [("s", i, who, int(a * 1000), int(b * 1000), 1.0, 1.0) for i, (who, a, b) in enumerate([("A", 0, 2), ("A", 2.2, 4), ("B", 4, 4.3), ("A", 4.4, 6), ("B", 7, 9), ("B", 9, 9)])]
    turns = spark.createDataFrame(rows, "session_id string, pos long, speaker string, start_ms long, end_ms long, confidence double, diarization_confidence double")
    assert [(r.speaker, r.start_ms, r.end_ms) for r in align.smooth_turns(turns).orderBy("start_ms").collect()] == [("A", 0, 6000), ("B", 7000, 9000)]
    merged = align.merge_blocks(turns.withColumn("text", F.concat(F.lit("t"), "pos"))).orderBy("start_ms").collect()
    assert [(r.speaker, r.text) for r in merged] == [("A", "t0 t1"), ("B", "t2"), ("A", "t3"), ("B", "t4 t5")]
    said = align.conversation_turns(turns.withColumns({"text": F.lit("x"), "overlap": F.lit(False)})).orderBy("start_ms").collect()
    assert [(r.speaker, r.speaker_raw) for r in said] == [("CUSTOMER", "A"), ("AGENT", "B"), ("CUSTOMER", "A"), ("AGENT", "B")]


def test_smoothing_follows_the_plain_rule(spark):
    rng, rows = random.Random(2), []
    for s in range(7):
        t = 0
        for i in range(120):
            d = rng.choice([100, 300, 600, 900, 2000])
            rows.append((f"s{s}", i, rng.choice("AB"), t, t + d, rng.random(), rng.random()))
            t += d + rng.choice([-50, 0, 100, 400, 900])
    df = spark.createDataFrame(rows, "session_id string, pos long, speaker string, start_ms long, end_ms long, confidence double, diarization_confidence double")
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        k = kept[-1] if kept and kept[-1][0] == r[0] else None
        if k and ((r[2] == k[2] and 0 <= r[3] - k[4] <= 300) or r[4] - r[3] < 500):
            kept[-1] = (*k[:4], max(k[4], r[4]), (k[5] + r[5]) / 2, (k[6] + r[6]) / 2)
        else:
            kept.append(r)
    assert sorted(tuple(r) for r in align.smooth_turns(df).collect()) == sorted(kept)
    assert align.smooth_turns(df.limit(0)).count() == 0


def test_error_rates(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "dd", "\u00e9", "\u4e2d", "A"] + [f"w{i}" for i in range(300)]
    pairs = [("a b c d", "a x c"), ("abc", "abc"), ("", "x"), (None, "x"), ("x y", None), ("  a\u00a0b \n c", "a b c")]
    pairs += [(" ".join(rng.choices(words[: rng.choice([3, 7, 307])], k=rng.randrange(40))), " ".join(rng.choices(words, k=rng.randrange(40)))) for _ in range(60)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t string, s string").coalesce(1)
    rows = df.select("i", quality.word_error_rate(F.col("t"), F.col("s")).alias("w"), quality.character_error_rate(F.col("t"), F.col("s")).alias("c")).collect()
    for r in rows:
        a, b = ((x or "").split() for x in pairs[r.i])
        assert r.w == (edits(a, b) / len(a) if a else None), pairs[r.i]
    assert rows[1].c == 0.0 and rows[2].c is None


def test_the_library_stands_without_the_optional_subpackage():
    root = Path(__file__).parent.parent
    for path in (root / "parley").rglob("*.py"):
        if "llm" not in path.parts:
            assert "parley.llm" not in path.read_text(), path
