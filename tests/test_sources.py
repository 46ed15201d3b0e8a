import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.functions import text as X
from echoloom.functions import wav
from echoloom.session import materialize, scratch_root
from echoloom.sources import tables as T


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("clips")
    rng = np.random.default_rng(0)
    for side in ("positive", "negative"):
        os.makedirs(root / side / "deep")
        for i in range(3):
            (root / side / f"c{i}.wav").write_bytes(wav.encode(rng.normal(0, 0.2, 9000)))
    (root / "negative" / "deep" / "note.txt").write_text("no clip")
    (root / "negative" / "broken.wav").write_bytes(b"RIFFxxxx")
    (root / "other.flac").write_bytes(b"fLaC")
    return str(root)


def test_recursive_scan_keeps_clip_files(spark, tree):
    files = T.scan_clips(spark, tree)
    assert files.count() == 8 and "content" not in files.columns


def test_labels_come_from_the_directory(spark, tree):
    got = T.label_by_directory(T.scan_clips(spark, tree)).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {1: 3, 0: 4}


def test_decode_counts_errors_and_never_returns_silence(spark, tree):
    d = wav.decode_clips(T.scan_clips(spark, tree, "*.wav", content=True))
    bad = d.filter("error IS NOT NULL").collect()
    assert len(bad) == 1 and bad[0].samples is None and bad[0].path.endswith("broken.wav")
    assert all(len(r.samples) == 16000 and r.sr == 16000 for r in d.filter("error IS NULL").collect())


@pytest.mark.parametrize("n", [100, 16000, 16500])
def test_codec_round_trip(n):
    x = np.random.default_rng(n).uniform(-1.2, 1.2, n)
    y, sr, ch, err = wav.decode(wav.encode(x))
    left = (16000 - n) // 2 if n < 16000 else 0
    want = np.trunc(np.clip(x[:16000], -1, 1) * 32767) / 32768
    assert err is None and (sr, ch, len(y)) == (16000, 1, 16000)
    assert np.allclose(y[left:left + len(want)], want, atol=1e-6)


def test_index_round_trip_both_layouts_and_fallback(spark, tmp_path):
    rows = spark.createDataFrame([("a\\b\\dog__1.wav", 1.23456), ("us8k_7_siren.wav", 2.0)], "path string, s double")
    idx = T.index_rows(rows, F.col("s"), F.lit(16000))
    T.write_index(idx, str(tmp_path / "i"))
    got = {r.path: (r["class"], r.duration_s, r.sr) for r in T.read_index(spark, str(tmp_path / "i")).collect()}
    assert got == {"a/b/dog__1.wav": ("dog", 1.235, 16000), "us8k_7_siren.wav": ("us8k_siren", 2.0, 16000)}
    variant = tmp_path / "v"
    variant.mkdir()
    (variant / "p.csv").write_text("file,class,duration_s\nx\\y.wav,rain,3.5\n")
    r = T.read_index(spark, str(variant)).first()
    assert (r.path, r["class"], r.duration_s, r.sr) == ("x/y.wav", "rain", 3.5, None)
    empty = tmp_path / "e"
    empty.mkdir()
    (empty / "p.csv").write_text("path,class,duration_s,sr\n")
    back = T.read_index(spark, str(empty), fallback=spark.createDataFrame([("bank/fan.wav",)], "path string")).collect()
    assert [(r.path, r["class"]) for r in back] == [("bank/fan.wav", "fan")]


@pytest.mark.parametrize("name,label,full", [
    ("d/dog__1.wav", "dog", "dog"), ("proc_fan_hum_00.wav", "proc_fan_hum", "proc_fan_hum"),
    ("us8k_99_street_music.wav", "us8k_music", "street_music"), ("babble_small_group_4t_001.wav", "babble_small_group", "babble_small_group"),
    ("esc50_rain_3.wav", "rain", "rain"), ("esc50_3.wav", "esc50", "esc50"), ("hall.wav", "hall", "hall")])
def test_class_from_filename(spark, name, label, full):
    r = spark.createDataFrame([(name,)], "p string").select(
        X.class_from_filename(F.col("p")).alias("a"), X.class_full_label(F.col("p")).alias("b")).first()
    assert (r.a, r.b) == (label, full)


def test_shards_struct_or_list(spark):
    cell = "struct<bytes:binary,path:string>"
    a = spark.createDataFrame([((bytearray(b"ab"), "p1"), "dog"), ((bytearray(b""), "p2"), "cat"), (None, "cow")], f"audio {cell}, category string")
    b = spark.createDataFrame([([(bytearray(b"xyz"), "q")], 7), ([], 8)], f"audio array<{cell}>, speaker int")
    assert [(r.path, r["class"]) for r in T.shard_clips(a).collect()] == [("p1", "dog")]
    assert [(r.path, r["class"], r.speaker) for r in T.shard_clips(b).collect()] == [("q", "unknown", "7")]


def test_transcripts_skip_short_lines(spark, tmp_path):
    d = tmp_path / "a" / "b"
    d.mkdir(parents=True)
    (d / "x.trans.txt").write_text("u1 HELLO  WORLD\nu2\n\nu3 A\n")
    (d / "x.txt").write_text("u9 NOT READ\n")
    got = {r.utt_id: r.words for r in T.scan_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"u1": ["HELLO", "WORLD"], "u3": ["A"]}


def test_verify_reports_every_kind(spark):
    m = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], "name string, bytes long, sha256 string")
    act = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y"), ("e", 1, "x")], "name string, bytes long, sha256 string")
    assert {r.name: r.reason for r in T.verify(m, act).collect()} == {"b": "size", "c": "hash", "d": "missing", "e": "unlisted"}
    assert "empty manifest" in {r.reason for r in T.verify(m.limit(0), act).collect()}


def test_build_key_ignores_order_and_reuse(spark, tmp_path):
    assert T.build_key({"a": 1, "b": 2}, "d") == T.build_key({"b": 2, "a": 1}, "d") != T.build_key({"a": 1, "b": 2}, "e")
    df = spark.range(100).withColumnRenamed("id", "k")
    assert T.table_digest(df, ["k"]).first() == T.table_digest(df.orderBy(F.col("k").desc()), ["k"]).first()
    path = str(tmp_path / "bundle")
    assert not T.up_to_date(spark, path, "k1")
    T.manifest_totals(spark.createDataFrame([("a", 5, "x")], "name string, bytes long, sha256 string"), "k1").write.json(f"{path}/build")
    assert T.up_to_date(spark, path, "k1") and not T.up_to_date(spark, path, "k2")


def test_corpus_sink_prunes_partitions_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [0.5], "train"), (2, 3.0, [0.25], "val")], "id int, snr double, x array<double>, split string")
    path = str(tmp_path / "c")
    T.write_corpus(T.compact(df), path)
    back = spark.read.parquet(path)
    assert back.schema["x"].dataType.simpleString() == "array<float>"
    assert back.filter("id = 1").first().snr == 40.0
    plan = back.filter("split = 'val'").select("id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<id:int>" in plan


def test_history_round_trip(spark, tmp_path):
    h = spark.createDataFrame([(0, 0.1), (1, 0.4), (2, 0.3)], "epoch int, tpr double")
    T.write_history(h, {"lr": 0.1}, str(tmp_path / "h"))
    raw = [json.loads(x) for f in os.listdir(tmp_path / "h") if f.endswith(".json") for x in open(tmp_path / "h" / f)]
    assert len(raw) == 1 and raw[0]["best"] == {"epoch": 1, "tpr": 0.4}
    assert T.read_history(spark, str(tmp_path / "h"), "epoch int, tpr double").count() == 3


def test_shared_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and df.inputFiles()[0].startswith("file://" + scratch_root(spark))


def test_digest_sees_where_a_null_is(spark):
    rows = [("a", None, "b"), ("a", "b", None), ("a|b", None, ""), ("a", "b|", "")]
    got = {T.table_digest(spark.createDataFrame([r], "x string, y string, z string"), ["x", "y", "z"]).first()["digest"] for r in rows}
    assert len(got) == len(rows)


def test_index_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "i.csv").write_text("class,note,sr,path,duration_s\ndog,n,16000,a\\b.wav,1.25\ncat,n,x,c.wav,\n")
    got = sorted(map(tuple, T.read_index(spark, str(tmp_path / "i.csv")).collect()))
    assert got == [("a/b.wav", "dog", 1.25, 16000), ("c.wav", "cat", None, None)]
