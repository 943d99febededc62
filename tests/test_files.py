"""Readers and writers on files made here; the streaming form on a file stream."""

import gzip
import struct

import numpy as np
import pytest

from strandline.sources import readers as R
from strandline.sources import sinks as K
from strandline.streaming.bins import streaming_impulses


def test_decoding(spark, tmp_path):
    for name, data in {"a": "é".encode("utf-8-sig"), "b": "é".encode("utf-16"), "c": "é".encode(), "d": "é".encode("latin-1")}.items():
        (tmp_path / name).write_bytes(data)
    assert {r.path[-1]: r.text for r in R.read_texts(spark, str(tmp_path)).collect()} == dict.fromkeys("abcd", "é")
    (tmp_path / "e.csv").write_bytes("word,onset\nété,1.5\n".encode("utf-16"))
    assert [tuple(r) for r in R.read_decoded_csv(spark, str(tmp_path / "e.csv")).collect()] == [("été", 1.5)]


def test_trees(spark, tmp_path):
    assert R.tree_leaves("(S (NP (DT the) (NN dog)) (VP barks now))") == ["the", "dog", "barks", "now"]
    assert R.tree_leaves("(S (A a)") == ["a"] and R.tree_leaves("()") == []
    (tmp_path / "t").write_text("(S (A a) (B b))\n\n(S (C c))\n")
    assert [(r.sentence, r.tokens) for r in R.read_trees(spark, str(tmp_path)).collect()] == [(0, ["a", "b"]), (1, ["c"])]


def test_textgrid(spark, tmp_path):
    rows = "".join(f'intervals [{i}]:\n  xmin = {i}.5\n  xmax = {i + 1}e0\n  text = "{t}"\n' for i, t in enumerate(("The", "#", " ", "dog’s")))
    (tmp_path / "g").write_text(rows)
    got = [(r.onset, r.offset, r.normalized) for r in R.read_textgrid(spark, str(tmp_path), "en").collect()]
    assert got == [(0.5, 1.0, "the"), (3.5, 4.0, "dog's")]


def _nifti(values, order="<"):
    header = bytearray(352)
    struct.pack_into(f"{order}i", header, 0, 348)
    struct.pack_into(f"{order}8h", header, 40, 4, 2, 2, 1, values.shape[1], 1, 1, 1)
    struct.pack_into(f"{order}h", header, 70, 16)
    struct.pack_into(f"{order}f", header, 108, 352.0)
    struct.pack_into(f"{order}2f", header, 112, 2.0, 1.0)
    return bytes(header) + values.T.astype(f"{order}f4").tobytes()


def test_nifti(spark, tmp_path):
    values = np.arange(12, dtype="f4").reshape(4, 3)
    (tmp_path / "sub-EN001_x_task-lpp_run-07_space-MNI_bold.nii.gz").write_bytes(gzip.compress(_nifti(values)))
    (tmp_path / "sub-EN002_x_task-lpp_run-08_space-MNI_bold.nii.gz").write_bytes(_nifti(values, ">"))
    assert sorted((r.n_volumes, r.n_voxels) for r in R.read_nifti_headers(spark, str(tmp_path)).collect()) == [(3, 4), (3, 4)]
    for r in R.read_nifti(spark, str(tmp_path)).collect():
        assert r.ts == (values[r.voxel] * 2 + 1).tolist()
    runs = sorted((r.subject_id, r.language, r.task_name, r.original_run_label, r.is_fetched) for r in R.list_runs(spark, str(tmp_path)).collect())
    assert runs == [("EN001", "en", "lpp", 7, True), ("EN002", "en", "lpp", 8, False)]
    with pytest.raises(ValueError, match="348"):
        R.nifti_header(b"x")


def test_presence(spark, tmp_path):
    for p in ("EN/a_word.csv", "EN/b_word.csv", "FR/a_tree.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert {r.folder: (r.word, r.tree) for r in R.annotation_presence(spark, str(tmp_path), ["word", "tree"]).collect()} == {"EN": (2, 0), "FR": (0, 1)}


def test_contracts_and_upserts(spark, tmp_path):
    assert K.empty(spark, "permutations").count() == 0
    with pytest.raises(ValueError, match="lacks"):
        K.checked(spark.range(1), "permutations")
    path = f"{tmp_path}/t"
    make = lambda model, v: spark.createDataFrame([(model, v)], "model string, v int")
    K.write_partitions(make("a", 1).union(make("b", 1)), path, ["model"])
    K.write_partitions(make("b", 2), path, ["model"])
    assert sorted((r.model, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]
    K.write_table(make("a", 1), f"{tmp_path}/c", "\t")
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/c").first().model == "a"
    assert K.tagged("x/name.parquet", "fast") == "x/name__fast.parquet" and K.tagged("x/name", None) == "x/name"
    assert K.exactly_one(spark.createDataFrame([(1, None), (1, 2)], "a int, b int"), a=1, b=None).count() == 1


def test_resume(spark, tmp_path):
    path, made = f"{tmp_path}/chunks", []

    def compute(todo):
        made.append(sorted(r.k for r in todo.collect()))
        return todo.selectExpr("k", "k * 2 as v")

    K.append_missing(spark.createDataFrame([(1,), (2,)], "k int"), compute, path, {"layers": [1]}, ["k"])
    K.append_missing(spark.createDataFrame([(2,), (3,)], "k int"), compute, path, {"layers": [1]}, ["k"])
    assert made == [[1, 2], [3]] and spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="other settings"):
        K.append_missing(spark.createDataFrame([(4,)], "k int"), compute, path, {"layers": [2]}, ["k"])


def test_streaming(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:01' ts, 1 k UNION ALL SELECT timestamp'2024-01-01 00:00:02', 1 UNION ALL SELECT timestamp'2024-01-01 00:01:02', 2")
    rows.write.parquet(f"{tmp_path}/in")
    stream = streaming_impulses(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", ["k"], "1 minute", "10 minutes")
    q = stream.writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted((r.k, r.x) for r in streaming_impulses(rows, "ts", ["k"], "1 minute", "10 minutes").collect())
    assert sorted((r.k, r.x) for r in spark.table("bins").collect()) == want == [(1, 2), (2, 1)]
