"""Readers on files with odd contents, and a table of runs that is taken up again."""

import pytest
from pyspark.sql import functions as F

from sessiongrid.plans import runs
from sessiongrid.session import new_path, shared_folder
from sessiongrid.sources import captions, keypoints, store


@pytest.fixture
def folder(spark, tmp_path):
    return tmp_path


def test_captions_of_any_form(spark, folder):
    """Windows and old line ends, no blank lines, cue numbers, notes, several lines, empty cues and files."""
    texts = {
        "p1": "WEBVTT\r\n\r\n1\r\n00:01.000 --> 00:02.500\r\nA: one\r\ntwo\r\n\r\nNOTE x\r\n\r\n00:03.000 --> 00:04.000 align:start\r\nthree",
        "p2": "00:01.000 --> 00:02.000\nB: a\n00:02.000 --> 00:03.000\nb\n \nlost\n00:05.000 --> 00:06.000\n\n01:00:00.000 --> 01:00:01.000\nlast\n",
        "p3": "WEBVTT\r\r00:00.500 --> 00:00.750\rold\r", "p4": "", "p5": "WEBVTT",
    }
    for name, text in texts.items():
        (folder / f"{name}.vtt").write_bytes(text.encode())
    rows = captions.read_captions(spark, str(folder)).orderBy("participant", "seq").collect()
    assert [(r.participant, r.start_time, r.end_time, r.text) for r in rows] == [
        ("p1", 1.0, 2.5, " one\ntwo"), ("p1", 3.0, 4.0, "three"),
        ("p2", 1.0, 2.0, " a"), ("p2", 2.0, 3.0, "b"), ("p2", 5.0, 6.0, ""), ("p2", 3600.0, 3601.0, "last"), ("p3", 0.5, 0.75, "old"),
    ]
    with pytest.raises(ValueError, match="bytes; cut"):
        captions.read_captions(spark, str(folder), 100)


def test_keypoints_with_empty_and_broken_documents(spark, folder):
    (folder / "p7_frame0001_keypoints.json").write_text('{"people": [\n {"pose_keypoints_2d": [1, 2, 0.5]},\n {"pose_keypoints_2d": [9, 9, 9]}]}')
    (folder / "p7_frame0002_keypoints.json").write_text('{"people": []}')
    (folder / "p7_frame0003_keypoints.json").write_text('{"people": [')
    found = {b: sorted(((r.frame, r.keypoints) for r in keypoints.read_keypoints(spark, str(folder), broken=b).collect()), key=lambda f: f[0]) for b in ("null", "drop")}
    frames = [f for f, _ in found["null"]]
    assert len(frames) == 3 and found["null"] == [(frames[0], [1.0, 2.0, 0.5]), (frames[1], None), (frames[2], None)]
    assert found["drop"] == found["null"][:2]
    with pytest.raises(Exception):
        keypoints.read_keypoints(spark, str(folder), broken="fail").collect()
    with pytest.raises(ValueError):
        keypoints.read_keypoints(spark, str(folder), broken="other")


def test_media_are_listed_without_contents(spark, folder):
    for name in ("a.wav", "b.wav", "c.txt"):
        (folder / name).write_bytes(b"x" * 5000)
    media = store.list_media(spark, str(folder))
    assert sorted((r.stem, r.length) for r in media.collect()) == [("a", 5000), ("b", 5000)]
    plan = store.unmatched_media(media, spark.createDataFrame([("a",)], "stem string"))
    assert [r.stem for r in plan.collect()] == ["b"]
    scan = media._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in scan


def configs(spark, n=6):
    return spark.createDataFrame([(f"c{i}", i) for i in range(n)], "config_id string, x int")


def test_runs_are_taken_up_again(spark):
    """What is done is skipped, a run that failed is done again, results of others stay."""
    path, seen = new_path(spark), []

    def run(config, fail=()):
        seen.append(config.config_id)
        if config.x in fail:
            raise RuntimeError(config.config_id)
        return spark.range(config.x + 1).select((F.col("id") * config.x).alias("value"))

    assert runs.finished(spark, path) is None
    assert runs.run_configs(configs(spark, 2), run, path) == ["c0", "c1"]
    with pytest.raises(RuntimeError):
        runs.run_configs(configs(spark), lambda c: run(c, fail=(3,)), path, at_once=2)
    assert sorted(seen) == ["c0", "c1", "c2", "c3", "c4", "c5"]
    assert [r.config_id for r in runs.left_to_do(configs(spark), path).collect()] == ["c3"]
    assert runs.run_configs(configs(spark), run, path) == ["c3"] and runs.run_configs(configs(spark), run, path) == []
    table = runs.finished(spark, path).groupBy("config_id").agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    assert sorted(map(tuple, table.collect())) == [(f"c{i}", i + 1, i * i * (i + 1) // 2) for i in range(6)]
    assert shared_folder(spark) in path


def test_a_run_again_replaces_its_part(spark):
    path = new_path(spark)
    runs.run_configs(configs(spark, 1), lambda c: spark.range(5).toDF("value"), path)
    spark.range(3).select(F.col("id").alias("value"), F.lit("c0").alias("config_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_id").parquet(path)
    assert runs.finished(spark, path).count() == 3


def test_packed_documents_read_as_files(spark, folder):
    """Many documents to a file: the rows are those of one file a document, whatever the keys and however broken the text."""
    texts = ['{"people": [\n {"pose_keypoints_2d": [1, 2, 0.5]},\n {"pose_keypoints_2d": [9, 9, 9]}]}', '{"people": []}', '{"people": [', '{"people": [{}]}', '{"people": [{"pose_keypoints_2d": ["NaN", null, 2]}]}']
    rows = [(p, f, texts[(f or 0) % 5]) for p in ("a", "x y", "k=1/+%20", None) for f in (0, 1, 2, 3, 4, None)]
    df = spark.createDataFrame(rows, "participant string, frame long, value string")
    store.write_documents(df.union(df), str(folder / "packed"), ["participant", "frame"], "value")
    df.write.partitionBy("participant", "frame").text(str(folder / "files"))
    for broken in ("null", "drop"):
        few = keypoints.read_keypoints(spark, str(folder / "packed"), broken=broken, packed=True)
        many = keypoints.read_keypoints(spark, str(folder / "files"), broken=broken)
        assert few.schema.simpleString() == many.schema.simpleString()
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
        assert few.count() == (24 if broken == "null" else 20)
    assert len(list((folder / "packed").glob("*.parquet"))) < len(rows)
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        keypoints.read_keypoints(spark, str(folder / "packed"), broken="fail", packed=True).collect()
    named = spark.createDataFrame([("s3://b/p7_frame0003_keypoints.json", texts[0].encode())], "path string, content binary")
    named.write.parquet(str(folder / "named"))
    assert [tuple(r) for r in keypoints.read_keypoints(spark, str(folder / "named"), packed=True).collect()] == [("p7", 3, [1.0, 2.0, 0.5])]
