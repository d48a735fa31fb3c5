import hashlib
import random

from shelfline.plans import catalog
from shelfline.sources import identity as fi


def test_long_files_are_hashed_block_by_block(spark, tmp_path):
    draw = random.Random(3)
    want = {}
    for number, size in enumerate((1, 63, 999, 1000, 1001, 1024, 2000, 5003, 17_000)):
        file = tmp_path / ("sub dir" if number % 2 else ".") / f"a {number}#50%25 '.bin"
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(data := draw.randbytes(size))
        want[str(file.relative_to(tmp_path))] = hashlib.sha256(data).hexdigest()
    found = fi.file_hashes(spark, str(tmp_path), "*.bin", block=1000)
    assert {r.file: r.sha256 for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan  # long files are not read as one value


def test_a_task_reads_one_block(tmp_path, monkeypatch):
    data = random.Random(4).randbytes(10_007)
    (tmp_path / "x").write_bytes(data)
    state, steps = (f"file:{tmp_path}/x", len(data), 0, None, None), 0
    while not state[4]:
        before = state[2]
        state = fi.next_block(*state[:4], 700)
        assert 0 < state[2] - before <= 700
        steps += 1
    assert steps == 15 and state[4] == hashlib.sha256(data).hexdigest()
    monkeypatch.setattr(fi, "resumable", lambda: False)
    assert fi.next_block(f"file:{tmp_path}/x", len(data), 0, None, 700)[4] == state[4]


def test_long_files_of_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    """Such files are read split by split: file_identity_counts has no task that reads more than a block and a tenth."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./in", f"file://{tmp_path}")
    draw, block, want = random.Random(5), 1 << 19, {}
    # a block, its successor, whole records, a prime, less than two splits, and names that splits leave out or unpack
    sizes = {"a": block, "b {1},*?[x]": block + 1, "c": 3 * block, "d \\": 1_600_033, "e": 576_720, "_f=1": block + 7}
    for name, size in {f"{x}.parquet": n for x, n in sizes.items()}.items() | {("g.gz", block + 9)}:
        (tmp_path / name).write_bytes(data := draw.randbytes(size))
        want[name] = hashlib.sha256(data).hexdigest()
    found = fi.file_hashes(spark, "viewfs://files/in", block=block)
    assert {r.file: r.sha256 for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "g.gz" in plan and "_f=1" in plan and "d \\" not in plan  # only these two are read as one value
    at = 0
    for rows, part in fi.splits(spark.sparkContext, "viewfs://files/in/d \\.parquet", 1_600_033, block):
        held = spark.sparkContext.runJob(rows, list, [part])
        assert held[0][0] <= at and sum(len(data) for _, data in held) <= block * 1.1
        at = held[-1][0] + len(held[-1][1])
    assert at == 1_600_033
    monkeypatch.setattr(fi, "file_hashes", lambda *x, run=fi.file_hashes: run(*x, block=block))
    (row,) = catalog.queries()["file_identity_counts"](spark, "viewfs://files/in").collect()
    assert (row.matched, row.listed, row.passed) == (6, 6, True)
