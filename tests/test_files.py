"""Sources and sinks on odd inputs."""

import numpy as np
import pytest
from cartulary.sources import files
from pyspark.sql import functions as F


def test_npy_matrices(spark, tmp_path):
    m = np.random.default_rng(3).normal(size=(5000, 3)).astype(np.float32)
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "a.npy", m)
    np.save(tmp_path / "deep" / "b.npy", np.zeros((2, 3), np.float64))
    (tmp_path / "c.txt").write_text("no matrix")
    got = files.read_npy(spark, str(tmp_path)).collect()
    a = sorted((r.row, r.v) for r in got if r.file.endswith("a.npy"))
    assert len(got) == 5002 and np.array_equal(np.array([v for _, v in a], np.float32), m)
    norms = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(files.unit("v").alias("u")).collect()
    assert norms[0].u == [0.6, 0.8] and norms[1].u == [0.0, 0.0]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    assert [files.publish(spark.range(n), root) for n in (3, 5)] == [1, 2]
    # a version that was not finished is not seen, and its number is not used again
    spark.range(9).write.parquet(f"{root}/v3")
    assert files.current(spark, root).count() == 5 and files.current(spark, root, 1).count() == 3
    with pytest.raises(ValueError):
        files.current(spark, root, 3)
    assert files.publish(spark.range(7), root) == 4 and files.current(spark, root).count() == 7


def test_documents_without_front_matter(spark, tmp_path):
    for name, text in {"1": "---\ndocument: 1\ncode: A: b\nnumber: \n---\none\n\ntwo\n", "2": "no rules", "3": "", "4": "---\nnumber: 7\n---\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.txt").write_text(text)
    got = {r.file.split("/")[-2]: tuple(r)[1:] for r in files.read_canonical(spark, str(tmp_path), ["code", "number"]).collect()}
    assert got["1"] == ("1", "A: b", "", "one\n\ntwo", True) and got["2"] == (None, None, None, None, False) and got["4"] == ("", "", "7", "", True)
    assert "3" not in got or not got["3"][-1]


def test_bucket_of_names(spark):
    names = ["", "a", "documento-ñ", "x" * 300]

    def brute(name):
        h = 0
        for c in name.encode():
            h = (h * 131 + c) % 2**32
        return f"{h % 256:02x}"

    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", files.bucket_of(F.col("n")).alias("b")).collect()
    assert all(r.b == brute(r.n) for r in got)
