"""The jobs over a store, graph edge cases, streaming, and the guards of the entry points."""

from __future__ import annotations

import random
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import closure, retention
from chunkloom.plans.repository import Repository
from chunkloom.storage import staged
from chunkloom.streaming import ingest

ROOT = Path(__file__).resolve().parent.parent


def objects(spark, rows):
    return spark.createDataFrame([(i, "s", i, c) for i, c in rows], "object_id long, source string, stream_ord long, content binary")


def test_lifecycle(spark, tmp_path):
    rnd = random.Random(1)
    a, b, c = (rnd.randbytes(20_000) for _ in range(3))
    repo = Repository(spark, f"file://{tmp_path}/repo")
    repo.backup(objects(spark, [(1, a), (2, b), (3, a)]), "b1", "src", "2024-01-01 00:00:00")
    first = repo.read("index").count()
    repo.backup(objects(spark, [(1, a), (2, c)]), "b2", "src", "2024-01-02 00:00:00", "b1")
    assert repo.read("backups").where("backup_id = 'b2'").first().new_chunks == repo.read("index").count() - first
    assert {r.object_id: bytes(r.content) for r in repo.restore("b2").collect()} == {1: a, 2: c}
    assert {r.status for r in repo.verify("b1").collect()} == {"ok"}
    assert 0 < repo.verify("b1", 10.0, 7).count() < repo.verify("b1").count()
    # what b2 refers to stays
    plan = {r.backup_id: r.reasons for r in repo.forget(retention.KeepPolicy(last=1), "2024-02-01 00:00:00", dry_run=True).collect()}
    assert plan == {"b2": "last", "b1": "promoted: referenced by b2 via parent"}
    repo.export(["b2"], f"file://{tmp_path}/archive")
    other = Repository(spark, f"file://{tmp_path}/other")
    other.import_(f"file://{tmp_path}/archive")
    assert {r.object_id: bytes(r.content) for r in other.restore("b1").collect()} == {1: a, 2: b, 3: a}
    # an unrelated backup goes, and its chunks with it
    repo.backup(objects(spark, [(9, rnd.randbytes(9000))]), "b0", "old", "2023-01-01 00:00:00")
    before = repo.read("chunks").count()
    repo.forget(retention.KeepPolicy(last=1), "2024-02-01 00:00:00")
    stats = repo.prune().first()
    assert stats.orphans > 0 and repo.read("chunks").count() == before - stats.orphans
    assert {r.object_id: bytes(r.content) for r in repo.restore("b1").collect()} == {1: a, 2: b, 3: a}
    # damage shows
    bad = repo.read("chunks").withColumn("data", F.when(F.col("strong") == repo.read("chunks").first().strong, F.lit(b"xx")).otherwise(F.col("data")))
    state = repo.state()
    repo.commit(state | {"chunks": {repo.write("chunks", bad): sum(state["chunks"].values(), [])}})
    assert "hash-mismatch" in {r.status for r in repo.verify("b1").union(repo.verify("b2")).collect()}
    # folders that no commit names are not read and go
    repo.write("index", repo.read("index"))
    n = repo.read("index").count()
    repo.recover()
    assert repo.read("index").count() == n and len(list((tmp_path / "repo/index").iterdir())) <= 2 * len(repo.state()["index"])
    with pytest.raises(RuntimeError):
        repo.commit(state)  # of another job


def test_a_job_that_dies_between_two_writes_changes_nothing(spark, tmp_path, monkeypatch):
    """Each job dies before each of its writes and its commit; then the same content is backed up, verified and restored."""
    rnd = random.Random(4)
    a, b, c, d = (rnd.randbytes(9000) for _ in range(4))
    repo = Repository(spark, f"file://{tmp_path}/repo")
    repo.backup(objects(spark, [(1, a), (2, b), (3, d)]), "b1", "old", "2023-01-01 00:00:00")
    repo.backup(objects(spark, [(1, b)]), "b2", "new", "2024-01-01 00:00:00")
    repo.export(["b1"], f"file://{tmp_path}/archive")
    keep = retention.KeepPolicy(last=2)
    jobs = {"backup": lambda r: r.backup(objects(spark, [(1, c), (2, a)]), "b9", "x", "2024-02-01 00:00:00"), "forget": lambda r: r.forget(keep, "2024-03-01 00:00:00"), "prune": lambda r: r.prune(), "import": lambda r: r.import_(f"file://{tmp_path}/archive")}
    write, commit = Repository.write, Repository.commit
    for name, job in jobs.items():
        for k in range(6):
            at, left = repo.state(), [k]

            def dies(f, left=left):
                def run(self, *x):
                    if not left[0]:
                        raise OSError("lost")
                    left[0] -= 1
                    return f(self, *x)

                return run

            monkeypatch.setattr(Repository, "write", dies(write))
            monkeypatch.setattr(Repository, "commit", dies(commit))
            try:
                job(repo)
                died = False
            except OSError:
                died = True
            monkeypatch.undo()
            if not died:
                break
            assert repo.state() == at
        if name == "backup":
            assert {r.object_id: bytes(r.content) for r in repo.restore("b9").collect()} == {1: c, 2: a}
        assert k > 0 and {r.status for r in repo.verify("b2").collect()} == {"ok"}
    repo.backup(objects(spark, [(1, a), (2, c), (3, rnd.randbytes(5000))]), "b5", "y", "2024-04-01 00:00:00")
    repo.recover()
    assert {r.object_id: bytes(r.content) for r in repo.restore("b5").where("object_id < 3").collect()} == {1: a, 2: c}
    assert {r.object_id: bytes(r.content) for r in repo.restore("b1").collect()} == {1: a, 2: b, 3: d}
    places = repo.read("chunks").groupBy("pack_no", "store_offset").count()
    assert places.where("count > 1").isEmpty()


def test_excluded_chunks_are_zeros_and_lost_manifests_stop_forgetting(spark, tmp_path):
    rnd = random.Random(6)
    repo = Repository(spark, f"file://{tmp_path}/repo")
    repo.backup(objects(spark, [(1, rnd.randbytes(6000))]), "b1", "s", "2024-01-01 00:00:00")
    state = repo.state()
    e = repo.read("entries").withColumn("is_excluded", F.col("seq") == 1)
    cut = e.where("seq = 1").first()
    repo.commit(state | {"entries": {repo.write("entries", e): ["b1"]}})
    got = bytes(repo.restore("b1").first().content)
    assert len(got) == 6000 and got[cut.volume_offset : cut.volume_offset + cut.chunk_length] == bytes(cut.chunk_length)
    repo.commit(repo.state() | {"entries": {}})
    with pytest.raises(ValueError):
        repo.forget(retention.KeepPolicy(last=1), "2024-02-01 00:00:00")


def test_empty_policy_is_refused(spark):
    b = spark.createDataFrame([("a", datetime(2024, 1, 1))], "backup_id string, timestamp timestamp_ntz")
    with pytest.raises(ValueError):
        retention.keep_reasons(b, retention.KeepPolicy(), F.lit("2024-01-01").cast("timestamp_ntz"))


def test_closure_cycles_and_dangling(spark):
    ids = spark.createDataFrame([(x,) for x in "abcdx"], "id string")
    e = spark.createDataFrame([("a", "b", "parent"), ("b", "a", "parent"), ("b", "c", "data"), ("c", "gone", "parent")], "from_id string, to_id string, via string")
    seen, lost = closure.protect(ids, spark.createDataFrame([("a",)], "id string"), e)
    assert {r.id: (r.depth, r.promoted_by) for r in seen.collect()} == {"a": (0, None), "b": (1, "a"), "c": (2, "b")}
    assert [tuple(r) for r in lost.collect()] == [("c", "gone", "parent")]
    empty, _ = closure.protect(ids, spark.createDataFrame([], "id string"), e)
    assert empty.count() == 0


def test_ladder_ties_do_not_depend_on_order(spark):
    rows = [(f"b{i}", "s", "completed", datetime(2024, 1, 1, i % 3), datetime(2024, 1, 1, i % 3), None, None) for i in range(9)]
    schema = "backup_id string, source string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, parent_id string, snapshot_id string"
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    got = []
    for seed in (1, 2):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        got.append({tuple(r) for r in retention.select_ladder(spark.createDataFrame(shuffled, schema), retention.Ladder(), now).collect()})
    assert got[0] == got[1] and ("b2", True, "newest-of-source") in got[0]


def test_ingest_resumes(spark, tmp_path):
    rnd = random.Random(2)
    parts = [[(i, rnd.randbytes(3000)) for i in range(k * 3, k * 3 + 3)] for k in range(3)]
    parts[2].append((99, parts[0][0][1]))  # a copy from an earlier batch
    src = tmp_path / "in"

    def arrive(k):
        objects(spark, parts[k]).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        s = spark.readStream.schema("object_id long, source string, stream_ord long, content binary").parquet(str(src))
        ingest.ingest(s, f"file://{tmp_path}/store", f"file://{tmp_path}/check").awaitTermination()

    arrive(0)
    run()
    arrive(1)
    arrive(2)
    run()
    d = ingest.deltas(spark, f"file://{tmp_path}/store")
    whole = ingest.folded(spark, f"file://{tmp_path}/store")
    assert d.count() == whole.count() == spark.read.parquet(f"{tmp_path}/store/entries").select("strong").distinct().count()
    assert ingest.missing(spark, f"file://{tmp_path}/store").isEmpty()


def test_entry_without_llm(tmp_path):
    """The entry points import and work without the llm subpackage and the pipeline."""
    for name in ("chunkloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "chunkloom/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dedup_stats' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
