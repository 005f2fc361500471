"""Small golden tables: published inputs with their published results."""

import pytest
from pyspark.sql import functions as F

from sessiongrid import catalog
from sessiongrid.functions.text import REPROMPT_LABELS, array_literal
from sessiongrid.operators import aggregate, annotations, asof, rank, windows

# Annotations of three sessions (session, start, labels, error).
NOTES = [
    (2, 9.728605977460557, "prompt", 0),
    (2, 10.988636269722011, "confusion", 1),
    (2, 12.629605952667168, "filler words", 1),
    (2, 12.98124231329827, "more specific/longer prompt", 1),
    (2, 13.044913094647113, "confusion", 1),
    (2, 17.259484700976707, "confusion", 2),
    (2, 19.926060435762583, "filler words", 2),
    (2, 20.482818006761832, "repeated prompt, slower", 2),
    (2, 24.380014136396788, "frustration", 3),
    (2, 25.58663689716312, "quitting", 3),
    (2, 27.603454309541696, "confusion", 3),
    (4, 8.533750148760332, "prompt", 0),
    (4, 13.222351247933885, "repeated prompt, slower", 1),
    (4, 13.77729249527187, "confusion", 2),
    (4, 17.290767016528925, "simpler prompt", 2),
    (4, 19.3391609051787, "confusion", 3),
    (4, 20.66457521487603, "frustration", 3),
    (4, 22.45070896694215, "more specific/longer prompt", 3),
    (5, 6.449416033057852, "prompt", 0),
    (5, 12.752254429000754, "filler words", 1),
    (5, 15.18544320510894, "more specific/longer prompt", 1),
    (5, 18.152213068973, "confusion", 2),
    (5, 19.93455864763336, "simpler prompt", 2),
    (5, 26.53055231780616, "more specific/longer prompt", 3),
]
# Error times of the same sessions (session, start, end, error).
ERRORS = [
    (2, 10.08, 12.45, 1), (2, 16.52, 18.55, 2), (2, 23.09, 25.14, 3),
    (4, 10.45, 12.54, 1), (4, 14.60, 16.79, 2), (4, 18.93, 21.01, 3),
    (5, 9.96, 12.04, 1), (5, 17.28, 19.35, 2), (5, 21.88, 24.04, 3),
]
# Response times (session, error, seconds) and first annotation per session.
RESPONSES = [
    (2, 1, 2.9012423132982708), (2, 2, 3.9628180067618324), (4, 1, 2.7723512479338854), (4, 2, 2.690767016528925),
    (4, 3, 3.5207089669421485), (5, 1, 5.22544320510894), (5, 2, 2.6545586476333582), (5, 3, 4.650552317806159),
]
STARTS = {2: 9.728605977460557, 4: 8.533750148760332, 5: 6.449416033057852}
# Speaker turns of one session and the gaps picked from them.
TURNS = [
    ("participant", 9.650, 10.848), ("robot", 9.920, 12.097), ("participant", 12.434, 13.953), ("robot", 16.349, 18.576),
    ("participant", 19.977, 22.323), ("robot", 22.964, 25.175), ("robot", 29.630, 34.254), ("participant", 34.928, 36.059),
]
GAPS = "[0.33699999999999974, 1.4009999999999998, 0.6739999999999995]"
# Label counts and percentages of five sessions.
SHARES = [(2, 569, 48.9, 595, 51.1), (4, 601, 61.2, 381, 38.8), (5, 575, 49.6, 584, 50.4), (6, 619, 51.9, 573, 48.1), (7, 609, 53.8, 524, 46.2)]
# Feature importances, in falling order.
IMPORTANCES = """
gaze_0_x 0.0934678107680719, gaze_angle_x 0.0920560881523525, gaze_0_z 0.0894592314180146, gaze_1_x 0.0771700892123183,
gaze_1_z 0.0748964258013995, gaze_1_y 0.0576296865348656, gaze_angle_y 0.0566599279415575, gaze_0_y 0.0457445166272178,
rightwrist_x_delta 0.0327157171747265, rightwrist_y_delta 0.0316824950428212, righteye_x_delta 0.0233232163962402,
nose_x_delta 0.0190233128484096, rightelbow_x_delta 0.0178936542526623, leftwrist_x_delta 0.017854977945023,
lefteye_x_delta 0.0171033429004541, leftwrist_y_delta 0.0166074315772119, righteye_y_delta 0.0127417645686027,
nose_y_delta 0.012509596219323, lefteye_y_delta 0.012273781881492, leftear_x_delta 0.0102509176535788,
leftear_y_delta 0.0096811343152695, rightear_y_delta 0.0090353725725287, leftshoulder_x_delta 0.0085920583105003,
rightear_x_delta 0.0085891961589662, Loudness_sma3 0.0085087352626238, leftelbow_x_delta 0.0081281934110078,
spectralFlux_sma3 0.0077536203888742, rightelbow_y_delta 0.0076602213057416, leftelbow_y_delta 0.0073971093181562,
F2bandwidth_sma3nz 0.0073605318727911, F2frequency_sma3nz 0.0071497186898739, F3frequency_sma3nz 0.0070346150393101,
F1bandwidth_sma3nz 0.0068268880192291, F1frequency_sma3nz 0.0066598717963008, neck_x_delta 0.0066116753494169,
leftshoulder_y_delta 0.0062734848828473, rightshoulder_y_delta 0.0060447993115992, neck_y_delta 0.0057788880138963,
F3bandwidth_sma3nz 0.0056964326049289, rightshoulder_x_delta 0.0052636592890351, F0semitoneFrom27.5Hz_sma3nz 0.0051071567167555,
hammarbergIndex_sma3 0.0047090125114263, F3amplitudeLogRelF0_sma3nz 0.0043621215399918, alphaRatio_sma3 0.0030878969823307,
F2amplitudeLogRelF0_sma3nz 0.0025176384656811, mfcc3_sma3 0.002503816540873, mfcc1_sma3 0.0024604270052123,
slope0-500_sma3 0.0021916046425718, logRelF0-H1-A3_sma3nz 0.0020085247411951, jitterLocal_sma3nz 0.0020084643131262,
slope500-1500_sma3 0.0019442640582912, HNRdBACF_sma3nz 0.0018779967961549, mfcc4_sma3 0.0018089769640084,
shimmerLocaldB_sma3nz 0.0017124181116974, F1amplitudeLogRelF0_sma3nz 0.0017069126845952, mfcc2_sma3 0.0015459289413925,
logRelF0-H1-H2_sma3nz 0.0013366481554535
"""
# Published drops by rank.
DROPS = {0: 0.015335461717458587, 7: 0.39824281958753094, 9: 0.3584101997153597, 42: 0.41265125260083435, 55: 0.15657133486111374}


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(NOTES, "participant_num int, start double, labels string, error int")


@pytest.fixture(scope="module")
def errors(spark):
    return spark.createDataFrame(ERRORS, "participant_num int, start double, end double, error int")


def test_filtered_annotations_and_response_times(notes, errors):
    filtered = annotations.label_rows(notes, vocabulary=REPROMPT_LABELS)
    assert filtered.count() == 8
    got = annotations.response_times(filtered, errors, ["participant_num", "error"])
    rows = sorted((r.participant_num, r.error, r.response_time) for r in got.collect())
    for (p, e, t), (p2, e2, t2) in zip(rows, RESPONSES, strict=True):
        assert (p, e) == (p2, e2) and t == pytest.approx(t2, abs=1e-12)


def test_label_counts(notes):
    counts = {r.labels: r.n for r in aggregate.value_counts(annotations.label_rows(notes), "labels").collect()}
    assert counts["confusion"] == 7 and counts["more specific/longer prompt"] == 4 and counts["slower"] == 2


def test_error_numbers_by_asof(notes, errors):
    renamed = errors.select("participant_num", F.col("start").alias("at"), F.col("error").alias("latest"))
    found = asof.asof_join(notes, renamed, ["participant_num"], "start", "at", ["latest"])
    assert all(r.error == (r.latest or 0) for r in found.where("participant_num = 2").collect() if r.start > 17.5 or r.start < 10)


def test_interaction_start(notes):
    got = aggregate.interaction_start(notes, ["participant_num"]).collect()
    assert {r.participant_num: r.start for r in got} == STARTS


def test_published_gaps_are_turn_gaps(spark):
    turns = spark.createDataFrame([("p2", *t) for t in TURNS], "p string, speaker string, start double, end double")
    found = [r.gap for r in windows.turn_gaps(turns, ["p"]).collect()]
    published = spark.createDataFrame([(GAPS,)], "t string").select(array_literal(F.col("t"))).first()[0]
    assert all(any(abs(g - x) < 1e-9 for x in found) for g in published)


def test_label_shares(spark):
    rows = [(p, label) for p, n0, _, n1, _ in SHARES for label, n in ((0, n0), (1, n1)) for _ in range(n)]
    got = aggregate.label_shares(spark.createDataFrame(rows, "p int, y int"), ["p"], "y", [0, 1]).orderBy("p").collect()
    assert [(r.p, r.n_0, r.pct_0, r.n_1, r.pct_1) for r in got] == SHARES


def test_importance_cut(spark):
    pairs = [part.split() for part in IMPORTANCES.replace("\n", " ").split(",")]
    features = spark.createDataFrame([(n, float(v)) for n, v in pairs], "feature string, importance double")
    ranked = rank.ranked_drops(features).cache()
    drops = {r["rank"]: r.importance_drop for r in ranked.collect()}
    assert len(drops) == 57 and drops[56] is None
    assert all(drops[i] == pytest.approx(d, abs=1e-12) for i, d in DROPS.items())
    kept = [r.feature for r in rank.cut_at_drop(ranked, 0.4).collect()]
    groups = [catalog.modality_of_feature(f) for f in kept]
    assert len(kept) == 42 and (groups.count("pose"), groups.count("audio"), groups.count("gaze")) == (24, 10, 8)
