"""Readers and writers on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from sessiongrid import catalog
from sessiongrid.functions import clock, text, vectors
from sessiongrid.sources import captions, keypoints, metric_files, store, tables


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_entity_files_with_spaced_names(spark, tmp_path):
    (tmp_path / "p2_audio.csv").write_text("speaker, start,end,duration\nparticipant,09.650,10.848,1.198\nrobot,x,12.0,\n")
    (tmp_path / "p4_audio.csv").write_text("speaker, start,end,duration\nparticipant,1,2,1\n")
    read = tables.read_entity_files(spark, str(tmp_path), tables.TURNS)
    assert rows_of(read, "participant", "end") == [
        ("p2", "participant", 9.65, 10.848, 1.198), ("p2", "robot", None, 12.0, None),
        ("p4", "participant", 1.0, 2.0, 1.0),
    ]


def test_files_with_other_column_orders_are_read_by_name(spark, tmp_path):
    (tmp_path / "p1_audio.csv").write_text("speaker,start,end,duration\nrobot,1,2,1\n")
    (tmp_path / "p2_audio.csv").write_text("start, end,speaker,duration\n5,7,participant,2\n6,9,robot,3\n")
    (tmp_path / "p3_audio.csv").write_text("speaker,end\nrobot,4\n")
    read = tables.read_entity_files(spark, str(tmp_path), tables.TURNS)
    assert rows_of(read, "participant", "end") == [
        ("p1", "robot", 1.0, 2.0, 1.0), ("p2", "participant", 5.0, 7.0, 2.0), ("p2", "robot", 6.0, 9.0, 3.0), ("p3", "robot", None, 4.0, None),
    ]
    assert rows_of(tables.read_table(spark, str(tmp_path), tables.TURNS), "end")[1] == ("robot", None, 4.0, None)


def test_table_by_name_and_feature_list(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text(',feature,p_value\n0, AU01_r,0.5\n1,"logRelF0-H1-H2_sma3nz",bad\n')
    assert rows_of(tables.read_table(spark, str(path), tables.P_VALUES), "feature") == [(" AU01_r", 0.5), ("logRelF0-H1-H2_sma3nz", None)]
    assert tables.read_feature_list(spark, str(path)) == ["AU01_r", "logRelF0-H1-H2_sma3nz"]
    quoted = tmp_path / "labels.csv"
    quoted.write_text('participant_num,start,end,labels,error\n2,1.5,2,"repeated prompt, slower",2\n')
    read = tables.read_table(spark, str(quoted), tables.ANNOTATIONS)
    assert read.columns == tables.ANNOTATIONS.names and read.first().labels == "repeated prompt, slower"


def test_keypoint_documents(spark, tmp_path):
    (tmp_path / "p2_cam0007_keypoints.json").write_text(json.dumps({"people": [{"pose_keypoints_2d": [float(i) for i in range(75)]}]}))
    (tmp_path / "p2_cam0008_keypoints.json").write_text(json.dumps({"people": []}))
    read = keypoints.read_keypoints(spark, str(tmp_path))
    whole = keypoints.flatten_keypoints(read).orderBy("frame").collect()
    assert [(r.participant, r.frame) for r in whole] == [("p2", 7), ("p2", 8)]
    assert (whole[0].nose_x, whole[0].neck_c, whole[0].rightheel_c, whole[1].nose_x) == (0.0, 5.0, 74.0, None)
    upper = keypoints.upper_body(read).where("frame = 7").first()
    assert len(upper) == 2 + 36 and upper.righteye_x == 45.0 and upper.leftear_c == 56.0


def test_captions(spark, tmp_path):
    (tmp_path / "p3.vtt").write_text(
        "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\nSPEAKER 01: hello\nthere\n\n00:01:02.000 --> 01:00:03.000 align:start\nno speaker\n"
    )
    read = captions.read_captions(spark, str(tmp_path))
    assert [tuple(r)[2:] for r in read.orderBy("seq").collect()] == [(1.0, 2.5, " hello\nthere"), (62.0, 3603.0, "no speaker")]
    coded = captions.encode(read, "text", lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [r.embedding for r in coded.orderBy("seq").collect()] == [[12.0, 1.0], [10.0, 1.0]]


def test_diarisation_text(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER f 1 0.50 1.25 <NA> <NA> SPEAKER_00 <NA> <NA>\nother\n")
    assert rows_of(captions.read_turns(spark, str(tmp_path)), "start") == [("f", "SPEAKER_00", 0.5, 1.75, 1.25)]


def test_metric_files_round_trip(spark, tmp_path):
    rows = [(0, "accuracy", 0.5), (0, "loss", -1.5e-7), (1, "accuracy", 0.25)]
    metrics = spark.createDataFrame(rows, "fold int, metric string, value double")
    metric_files.write_metric_files(metrics, str(tmp_path / "m"))
    read = metric_files.read_metric_files(spark, str(tmp_path / "m"))
    assert sorted((r.metric, r.value) for r in read.collect()) == sorted((m, v) for _, m, v in rows)


def test_metric_lines(spark):
    lines = ["accuracy: 0.5", "=====", "Metrics for x Sweep: y", "f1: .25 more", "gap: -3e-2"]
    df = spark.createDataFrame([("a", line) for line in lines], "file string, value string")
    assert {(r.metric, r.value) for r in metric_files.parse_metric_lines(df).collect()} == {("accuracy", 0.5), ("f1", 0.25), ("gap", -0.03)}


def test_store_media_and_pending(spark, tmp_path):
    frames = spark.createDataFrame([("a", i, [1.0 * i, 2.0]) for i in range(10)] + [("b", 0, [9.0, 9.0])], "e string, frame int, v array<double>")
    store.write_frames(frames, str(tmp_path / "t"), ["e"], rows_per_file=4)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 11
    store.write_frames(frames.drop("v"), str(tmp_path / "c"), file_format="csv")
    assert tables.read_raw(spark, str(tmp_path / "c")).count() == 11
    store.write_vectors(frames, str(tmp_path / "v"), ["e", "frame"], "v")
    wanted = spark.createDataFrame([("a", 3), ("z", 0)], "e string, frame int")
    got = {r.e: r.v for r in store.read_vectors(spark, str(tmp_path / "v"), wanted, ["e", "frame"]).collect()}
    assert got == {"a": [3.0, 2.0], "z": None}
    assert store.pending(frames, wanted, ["e", "frame"]).count() == 10
    for name in ("1.wav", "2.wav", "x.txt"):
        (tmp_path / name).write_bytes(b"abc")
    media = store.list_media(spark, str(tmp_path))
    assert sorted((r.stem, r.length) for r in media.collect()) == [("1", 3), ("2", 3)]
    assert [r.stem for r in store.unmatched_media(media, spark.createDataFrame([("1",)], "stem string")).collect()] == ["2"]


def test_clock_texts(spark):
    cases = {
        "0 days 00:00:00.02": (0.02, 0), "0 days 00:01:02": (62.0, 1858), "0 days 01:00:00.500000": (3600.5, 107906),
        "00:00:10.5": (10.5, 314), "bad": (None, None), None: (None, None),
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = df.select("c", clock.clock_seconds(F.col("c")).alias("s"), clock.clock_to_frame(F.col("c")).alias("f")).collect()
    for r in got:
        seconds, frame = cases[r.c]
        assert r.s == (None if seconds is None else pytest.approx(seconds)) and r.f == frame


def test_names(spark):
    df = spark.createDataFrame([("a/b\\p7.wav_x.csv", 8), ("p2_cam0123_k.json", 9)], "p string, n int")
    got = df.select(
        text.file_stem(F.col("p")).alias("stem"), text.frame_of_name(F.col("p")).alias("frame"), text.pair_session_id(F.col("n")).alias("s")
    ).collect()
    assert [tuple(r) for r in got] == [("p7.wav_x", None, "89_0"), ("p2_cam0123_k", 123, "89_1")]


def test_label_lists(spark):
    df = spark.createDataFrame([('"repeated prompt, slower"',), ("prompt",), (None,), ("confusion",)], "t string")
    got = df.select(
        text.split_labels(F.col("t"), text.ANNOTATION_LABELS).alias("known"),
        text.other_bucket(text.split_labels(F.col("t")), text.ANNOTATION_LABELS).alias("other"),
        text.category_of(F.get(text.split_labels(F.col("t")), 0), text.ANNOTATION_CATEGORIES).alias("category"),
    ).collect()
    assert [r.known for r in got] == [["repeated prompt", "slower"], [], [], ["confusion"]]
    assert [r.other for r in got] == [["repeated prompt", "slower"], ["other"], [], ["confusion"]]
    assert [r.category for r in got] == ["reprompting strategies", None, None, "emotion"]


def test_vectors(spark):
    row = spark.range(1).select(
        vectors.argmax(F.array(*map(F.lit, [0.2, 0.7, 0.7]))).alias("argmax"),
        vectors.mean_vector([F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.5))]).alias("mean"),
        vectors.one_hot(F.lit(2), 4).alias("hot"),
        vectors.fit_length(F.array(F.lit(1.0)), 3).alias("pad"),
        vectors.fit_length(F.array(*map(F.lit, [1.0, 2.0, 3.0])), 2).alias("cut"),
        vectors.affine(F.array(F.lit(3.0)), 1.0, 2.0).alias("affine"),
        vectors.threshold_class(F.lit(0.5)).alias("half"),
    ).first()
    assert tuple(row) == (1, [0.5, 0.5], [0, 0, 1, 0], [1, 0, 0], [1, 2], [0.5], 0)


def test_catalog_counts_and_selection(spark):
    assert [len(catalog.GROUPS[g]) for g in ("pose", "facial", "audio", "gaze")] == [24, 35, 25, 8]
    frame = spark.createDataFrame([], catalog.frame_schema())
    assert len(catalog.feature_names(frame)) == 92
    assert catalog.feature_names(catalog.select_modalities(frame, "audio_pose"))[0] == "Loudness_sma3"
    assert len(catalog.feature_names(catalog.select_by_flags(frame, False, True, False))) == 43
    only = catalog.select_modalities(frame, "audio", [" F0semitoneFrom27.5Hz_sma3nz", "AU01_r"])
    assert catalog.feature_names(only) == ["F0semitoneFrom27.5Hz_sma3nz"]
    assert catalog.matching_names(frame, "_r$") == [n for n in catalog.FACIAL if n.endswith("_r")]
    assert catalog.modality_of_feature(" gaze_0_x") == "gaze"
    with pytest.raises(ValueError):
        catalog.parse_modality("pose_smell")
