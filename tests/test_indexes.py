"""The cell index, numbering, merging, backups and the registry of runs on small tables."""

import numpy as np
import pytest
from cartulary.operators import cells, relational, runs
from cartulary.sources import files
from pyspark.sql import functions as F


def neighbours(v, q, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u[q] @ u.T
    return {(a, int(b)) for a, row in zip(q, near) for b in np.lexsort((np.arange(len(v)), -row.round(6)))[:k]}


def test_cells_find_neighbours(spark, tmp_path):
    rng = np.random.default_rng(4)
    clustered = (rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] * 3 + rng.normal(size=(3000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(clustered)], "i long, v array<float>")
    n = cells.build(rows, f"{tmp_path}/cells", sample=1000)
    assert n == 55
    asked = rows.where("i % 50 = 0").select(F.col("i").alias("q"), "v")
    want = neighbours(clustered.astype(float), list(range(0, 3000, 50)), 10)
    share = {}
    for probes in (1, 5, 55):
        found = cells.search(spark, f"{tmp_path}/cells", asked, 10, probes=probes, rows=40).collect()
        share[probes] = len({(r.q, r.i) for r in found} & want) / len(want)
    assert share[1] < share[5] and share[5] >= 0.9 and share[55] >= 0.999
    empty = rows.limit(0)
    assert cells.build(empty, f"{tmp_path}/none") == 0


def test_cells_recall_on_the_test_vectors(spark, tmp_path):
    """These vectors form no clusters, so three quarters of the cells are opened for a recall of 0.9."""
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted(t.collect(), key=lambda r: r.vec_id)
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    n = cells.build(t.selectExpr("vec_id as i", "embedding as v"), f"{tmp_path}/cells")
    found = cells.search(spark, f"{tmp_path}/cells", t.where("vec_id % 100 = 0").selectExpr("vec_id as q", "embedding as v"), 10, probes=-(-3 * n // 4)).collect()
    q = [k for k, i in enumerate(ids) if i % 100 == 0]
    want = {(ids[a], ids[b]) for a, b in neighbours(v, q, 10)}
    assert len({(r.q, r.i) for r in found} & want) / len(want) >= 0.9


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.lit("a").alias("s"))
    assert [(r.x, r.k) for r in relational.numbered(df, ["s", "x"], "k").orderBy("k").collect()] == [(i, i) for i in range(1000)]
    assert relational.numbered(df.limit(0), ["s", "x"], "k").count() == 0


def test_merge_guards(spark):
    make = lambda rows: spark.createDataFrame(rows, "i long, doc string, v array<double>")
    one, two = make([(0, "a", [1.0, 2.0]), (7, "b", [0.0, 1.0])]), make([(0, "c", [1.0, 1.0]), (10**10, "d", [1.0, 0.0])])
    got = {(r.i, r.doc) for r in relational.merged_index(one, two, "i", "doc", "v").collect()}
    assert got == {(0, "a"), (7, "b"), (8, "c"), (10**10 + 8, "d")}
    for bad in ([(0, "c", [1.0])], [(0, "a", [1.0, 1.0])], [(0, "c", [1.0, 1.0]), (0, "d", [1.0, 1.0])]):
        with pytest.raises(ValueError):
            relational.merged_index(one, make(bad), "i", "doc", "v")
    assert relational.merged_index(one.limit(0), two, "i", "doc", "v").count() == 2


def test_first_copy_is_kept(spark, tmp_path):
    path = f"{tmp_path}/t"
    made = [files.replace_keeping_first(spark.createDataFrame([(k,)], "k int"), path) for k in range(4)]
    assert made == [False, True, False, False]
    assert [r.k for r in spark.read.parquet(path).collect()] == [3] and [r.k for r in spark.read.parquet(f"{path}.bak").collect()] == [0]


def test_run_registry(spark, tmp_path):
    root, now = f"{tmp_path}/runs", iter(range(100))
    r = runs.Registry(spark, root, lambda: float(next(now)))
    a = r.start("collect", "ana")
    with pytest.raises(ValueError, match="run 1"):
        r.start("index", "luis")
    assert r.cancel(a) and not r.cancel(a) and r.finish(a, 0).state == "cancelled"
    b = r.start("index", "ana", owner="7")
    again = runs.Registry(spark, root)  # after a restart
    assert [x.id for x in again.adopt(lambda owner: True)] == [b.id] and again.running().id == b.id
    assert again.adopt(lambda owner: False) == [] and again.runs[b.id].state == "interrupted"
    seen = []
    step = lambda name, ok=True: (name, name == "replace", lambda: seen.append(name) if ok else 1 / 0)
    run, done = runs.orchestrate(again, "update", [step("replace"), step("collect"), step("build")], "timer")
    assert done == seen == ["collect", "build", "replace"] and run.state == "ok"
    with pytest.raises(RuntimeError, match="build"):
        runs.orchestrate(again, "update", [step("replace"), step("collect"), step("build", False)], "timer")
    assert seen[3:] == ["collect"] and again.runs[max(again.runs)].state == "error" and again.running() is None


def test_rebuild_needs_metadata(spark, tmp_path):
    frag = spark.createDataFrame([(1, "a"), (2, "b")], "i long, doc string")
    with pytest.raises(ValueError):
        runs.rebuild(frag, frag.limit(0), f"{tmp_path}/index", lambda f, m: f)
    runs.rebuild(frag, frag, f"{tmp_path}/index", lambda f, m: f)
    assert runs.rebuild(frag, frag, f"{tmp_path}/index", lambda f, m: f.where("i = 1")) == 2
    assert files.current(spark, f"{tmp_path}/index").count() == 1 and files.current(spark, f"{tmp_path}/index", 1).count() == 2
