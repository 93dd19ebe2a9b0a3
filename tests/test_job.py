"""The whole job, its checkpoints, its command line, and streams."""

import json
import os
import random
import time

import pytest
from pyspark import TaskContext

from strake.operators import boundaries as B
from strake.operators import sampling, sorting, validation
from strake.plans import checkpoints as C
from strake.plans import cli, job
from strake.plans import queries as Q
from strake.sources import records as S
from strake.streaming import progress


@pytest.fixture
def inputs(tmp_path):
    r = random.Random(7)
    data = [r.randbytes(100) for _ in range(3000)]
    data += data[:50]
    for i, part in enumerate((data[:1000], data[1000:2500], data[2500:])):
        (tmp_path / f"in{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"in{i % 2}" / f"f{i}").write_bytes(b"".join(part) + b"x" * (37 * (i == 1)))
    return [str(tmp_path / "in0"), str(tmp_path / "in1")], sorted(data)


def written(path):
    return b"".join(open(p, "rb").read() for _, p in S.list_outputs(path))


@pytest.mark.parametrize("sample", ["blocks", "bernoulli", "systematic", "prefix"])
def test_sort_job(spark, inputs, tmp_path, sample):
    paths, want = inputs
    done = job.run(spark, job.SortJob(paths, str(tmp_path / "out"), workers=2, partitions=7, sample=sample, rate=0.05, validate=True))
    assert written(str(tmp_path / "out")) == b"".join(want)
    assert done["partitions"] == "7" and len(S.list_outputs(str(tmp_path / "out"))) == 7
    assert (done["sorted"], done["ordered"], done["same"], done["records"]) == ("True", "True", "True", "3050")


def test_two_runs_are_the_same(spark, inputs, tmp_path):
    paths, _ = inputs
    for out in ("a", "b"):
        job.run(spark, job.SortJob(paths, str(tmp_path / out), partitions=5, rate=0.1))
    assert [open(p, "rb").read() for _, p in S.list_outputs(str(tmp_path / "a"))] == [open(p, "rb").read() for _, p in S.list_outputs(str(tmp_path / "b"))]


def test_one_partition_and_no_input(spark, inputs, tmp_path):
    paths, want = inputs
    job.run(spark, job.SortJob(paths, str(tmp_path / "one"), partitions=1))
    assert written(str(tmp_path / "one")) == b"".join(want)
    (tmp_path / "empty").mkdir()
    done = job.run(spark, job.SortJob([str(tmp_path / "empty")], str(tmp_path / "none"), validate=True))
    assert done["records"] == "0" and written(str(tmp_path / "none")) == b""


def test_equal_keys_and_sorted_input(spark, tmp_path):
    data = [b"k" * 10 + bytes([i]) * 90 for i in range(200)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_bytes(b"".join(data))
    job.run(spark, job.SortJob([str(tmp_path / "in")], str(tmp_path / "out"), partitions=4, rate=0.5))
    assert written(str(tmp_path / "out")) == b"".join(data)


def test_text_input_gives_binary_output(spark, tmp_path):
    r = random.Random(1)
    data = [r.randbytes(100) for _ in range(50)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t").write_text("".join(f"{d[:10].hex()} {d[10:].hex()}\n" for d in data))
    job.run(spark, job.SortJob([str(tmp_path / "in")], str(tmp_path / "out"), partitions=3, rate=0.5))
    assert written(str(tmp_path / "out")) == b"".join(sorted(data))


def test_a_finished_job_is_not_run_again(spark, inputs, tmp_path):
    paths, _ = inputs
    plan = job.SortJob(paths, str(tmp_path / "out"), partitions=3, checkpoint_dir=str(tmp_path / "cp"), job_id="j")
    first = job.run(spark, plan)
    assert "resumed" not in first and job.run(spark, plan)["resumed"]


def test_a_failed_job_goes_on_with_its_boundaries(spark, inputs, tmp_path):
    paths, want = inputs
    limits = [b"\x40" + b"\0" * 9, b"\x90" + b"\0" * 9]
    marks = C.Checkpoints("j", str(tmp_path / "cp"))
    marks.save("SORTING", C.State(boundaries=[b.hex() for b in limits]), 0.4)
    job.run(spark, job.SortJob(paths, str(tmp_path / "out"), partitions=9, checkpoint_dir=str(tmp_path / "cp"), job_id="j"))
    assert [os.path.getsize(p) // 100 for _, p in S.list_outputs(str(tmp_path / "out"))] == [sum(d[:1] < b"\x40" for d in want), sum(b"\x40" <= d[:1] < b"\x90" for d in want), sum(d[:1] >= b"\x90" for d in want)]
    assert written(str(tmp_path / "out")) == b"".join(want)


def test_a_job_that_fails_says_so(spark, inputs, tmp_path):
    paths, _ = inputs
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "partition.0").write_bytes(b"")
    with pytest.raises(Exception, match="output already"):
        job.run(spark, job.SortJob(paths, str(tmp_path / "out"), partitions=2, checkpoint_dir=str(tmp_path / "cp"), job_id="j"))
    assert C.Checkpoints("j", str(tmp_path / "cp")).latest()["phase"] == "FAILED"


def test_a_task_that_is_tried_again_writes_once(inputs, tmp_path):
    """Two attempts at a partition stage different files; only the one that is committed stays."""
    paths, _ = inputs
    writer = S.RecordWriter({"path": str(tmp_path / "out")}, False)
    (batch,) = [b for b in S.RecordReader({"path": paths[0]}, S.R.SCHEMA).read(S.plan_splits(paths[0], "binary")[0])]
    attempts = []
    for n in (1, 2):

        class Task:
            partitionId = staticmethod(lambda: 0)
            taskAttemptId = staticmethod(lambda n=n: n)

        old, TaskContext.get = TaskContext.get, staticmethod(Task)
        try:
            attempts.append(writer.write(iter([batch])))
        finally:
            TaskContext.get = old
    writer.commit([attempts[1]])
    assert os.listdir(tmp_path / "out") == ["partition.0"] and os.path.getsize(tmp_path / "out" / "partition.0") == 100 * batch.num_rows


def test_checkpoints(tmp_path):
    marks = C.Checkpoints("w", str(tmp_path))
    assert marks.latest() is None and marks.statistics() == (0, 0)
    state = C.State(inputs=["a"], boundaries=["00ff"], shuffle_map={0: 1, 3: 2}, outputs=[1], notes={"k": "v"})
    names = []
    for i, phase in enumerate(C.PHASES):
        names.append(marks.save(phase, state, i / 10))
        time.sleep(0.003)
    assert marks.latest()["phase"] == "COMPLETED" and C.restored(marks.latest()) == state
    assert all(marks.valid(n) for n in names) and not marks.valid("other")
    n, size = marks.statistics()
    assert n == len(names) and size > 0
    with open(os.path.join(marks.folder, f"{names[-1]}.json"), "w") as f:
        f.write("{ broken")
    assert marks.latest()["phase"] == "MERGING"  # a broken one does not hide the one before
    marks.keep(3)
    assert marks.statistics()[0] == 3
    marks.drop_older(60)
    assert marks.statistics()[0] == 2
    marks.drop_all()
    assert marks.statistics() == (0, 0)


def test_a_checkpoint_with_impossible_progress_is_invalid(tmp_path):
    marks = C.Checkpoints("w", str(tmp_path))
    assert not marks.valid(marks.save("SORTING", C.State(), 1.5)) and marks.latest() is None


def test_phases():
    assert [C.next_phase(p) for p in C.PHASES] == [*C.PHASES[1:], C.FAILED] and C.next_phase("x") == C.FAILED
    assert C.may_follow("SAMPLING", "WAITING_FOR_PARTITIONS") and not C.may_follow("SAMPLING", "MERGING")
    assert C.may_follow("MERGING", C.FAILED) and C.may_follow(C.FAILED, "INITIALIZING") and not C.may_follow(C.FAILED, "SORTING")
    assert [C.on_error(p, 1, 3) for p in ("SAMPLING", "MERGING", "COMPLETED")] == ["continue", "retry", "abort"] and C.on_error("SORTING", 2, 3) == "abort"


def test_a_job_goes_through_its_phases(spark, inputs, tmp_path, monkeypatch):
    """In order and none left out; what is not allowed raises."""
    paths, _ = inputs
    seen = []
    save = C.Checkpoints.save
    monkeypatch.setattr(C.Checkpoints, "save", lambda self, phase, state, progress: (seen.append(phase), save(self, phase, state, progress))[1])
    job.run(spark, job.SortJob(paths, str(tmp_path / "out"), partitions=3, checkpoint_dir=str(tmp_path / "cp"), replicate=True))
    assert seen == list(C.PHASES)
    phases = C.Phases()
    with pytest.raises(ValueError, match="does not go"):
        phases.enter("SORTING")
    phases.enter("INITIALIZING")
    with pytest.raises(ValueError, match="does not go"):
        phases.enter("MERGING")
    assert phases.enter(C.FAILED) and phases.enter("INITIALIZING")


def test_writing_is_tried_again(spark, inputs, tmp_path, monkeypatch):
    """An error while records are written is tried again, as the policy says; one while they are sampled is not."""
    paths, want = inputs
    tries = []
    write = job.write_records

    def fails_once(*args, **kwargs):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("lost")
        return write(*args, **kwargs)

    monkeypatch.setattr(job, "write_records", fails_once)
    done = job.run(spark, job.SortJob(paths, str(tmp_path / "out"), partitions=3))
    assert len(tries) == 2 and written(str(tmp_path / "out")) == b"".join(want) and done["records_written"] == "3050"
    monkeypatch.setattr(job, "sample_keys", lambda *a: (tries.append(1), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        job.run(spark, job.SortJob(paths, str(tmp_path / "out2"), partitions=3))
    assert len(tries) == 3


def test_a_job_needs_space_and_has_a_seed_of_its_own(spark, inputs, tmp_path, monkeypatch):
    paths, _ = inputs
    seeds = []
    read = job.read_records
    monkeypatch.setattr(job, "read_records", lambda *a, **k: (seeds.append(k.get("seed")), read(*a, **k))[1])
    for name in ("worker-1", "worker-2"):
        job.run(spark, job.SortJob(paths, str(tmp_path / name), partitions=2, job_id=name))
    assert [s for s in seeds if s is not None] == [sampling.seed_of("worker-1"), sampling.seed_of("worker-2")]
    monkeypatch.setattr(job, "enough_space", lambda path, total: False)
    with pytest.raises(OSError, match="may take"):
        job.run(spark, job.SortJob(paths, str(tmp_path / "out"), partitions=2))
    job.run(spark, job.SortJob(paths, str(tmp_path / "out"), partitions=2, check_space=False))


def test_a_job_says_how_far_it_is(spark, inputs, tmp_path):
    paths, _ = inputs
    said = []
    with job._Watch(spark, said.append):
        time.sleep(1.3)
    assert said and all(isinstance(p, dict) for p in said)


def test_checkpoints_on_other_file_systems(tmp_path):
    marks = C.Checkpoints("w", f"file://{tmp_path}/cp")
    marks.save("SAMPLING", C.State(), 0.1)
    assert marks.latest()["phase"] == "SAMPLING" and os.listdir(tmp_path / "cp" / "w")


def test_space():
    assert job.required_bytes(1000) == 5040 and job.enough_space("/", 1) and not job.enough_space("/", 1 << 60)


def test_disk_usage(inputs):
    paths, _ = inputs
    used = job.disk_usage({"a": paths[0], "b": paths[1]})
    assert used["total"] == 3050 * 100 + 37 and "total: 0.29 MB" in job.readable(used)


def test_command_line(spark, inputs, tmp_path, capsys):
    paths, want = inputs
    assert cli.main(["sort", "-I", *paths, "-O", str(tmp_path / "out"), "-p", "4", "--rate", "0.1", "--validate"]) == 0
    assert json.loads(capsys.readouterr().out)["same"] == "True" and written(str(tmp_path / "out")) == b"".join(want)
    assert cli.main(["validate", "-O", str(tmp_path / "out")]) == 0
    a, b = (tmp_path / "out" / f"partition.{i}" for i in (0, 3))
    data = a.read_bytes()
    a.write_bytes(b.read_bytes())
    b.write_bytes(data)
    assert cli.main(["validate", "-O", str(tmp_path / "out")]) == 1


def test_progress_is_counted(spark, inputs):
    paths, _ = inputs
    ordered, limits = sorting.range_sort(S.read_records(spark, paths, "binary"), 4, rate=0.1)
    df, seen = progress.observed(ordered)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["records"] == 3050 and seen.get["bytes"] == 305_000 and len(limits) == 3
    assert progress.stage_progress(spark) == {}


def test_transport_checksum_is_the_order_s(spark, inputs):
    paths, want = inputs
    from hashlib import md5

    ordered, _ = sorting.range_sort(S.read_records(spark, paths, "binary"), 1, [])
    assert validation.transport_checksum(ordered).first().md5 == md5(b"".join(want)).hexdigest()


def test_runs_of_a_stream(spark, tmp_path):
    for i in range(2):
        rows = [(bytes([(j * 7 + i) % 256]) * 10, b"v" * 90) for j in range(40)]
        spark.createDataFrame(rows, "key binary, value binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key binary, value binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = progress.sorted_runs(stream, str(tmp_path / "runs"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    runs = [spark.read.parquet(str(tmp_path / "runs" / f"run={i}")) for i in range(2)]
    assert all(r.count() == 40 for r in runs)
    merged = [bytes(r.key) for r in sorting.merge_runs(runs).collect()]
    assert merged == sorted(merged) and len(merged) == 80


def test_every_query_has_rows(spark):
    for name in ("global_sort", "sample_bernoulli", "sample_reservoir", "partition_checksum"):
        assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(Q.ORACLES) == len(Q.QUERIES) - 2 and B.MIB == 1 << 20
