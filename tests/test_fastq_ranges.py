"""FASTQ files and mate pairs read by byte ranges."""

import gzip
import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqlattice.contracts import ContractError
from seqlattice.sources import fastq


def write(path, rows, end="\n", last=True):
    text = end.join(line for name, seq, qual in rows for line in (f"@{name}", seq, "+anything", qual))
    path.write_bytes((text + (end if last else "")).encode())
    return str(path)


def reads(seed, n, longest=60):
    """Qualities begin with marks of records now and then, and some reads are empty."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        size = int(rng.integers(0, longest))
        qual = "".join(rng.choice(list("@+IF#"), size))
        rows.append((f"r{k} x" if k % 3 else f"r{k}", "".join(rng.choice(list("ACGTN"), size)), qual))
    return rows


@pytest.mark.parametrize("end,last", [("\n", True), ("\n", False), ("\r\n", True)])
def test_any_cut_finds_the_next_record(tmp_path, end, last):
    rows = reads(1, 40)
    path = write(tmp_path / "a.fastq", rows, end, last)
    data = open(path, "rb").read()
    starts, at = [], 0
    for name, seq, qual in rows:
        starts.append(at)
        at += len(end.join([f"@{name}", seq, "+anything", qual, ""]))
    handle = pa.PythonFile(io.BytesIO(data), mode="r")
    for cut in range(len(data)):
        want = next((s for s in starts if s >= cut), len(data))
        assert fastq.record_start(handle, len(data), cut) == want


@pytest.mark.parametrize("split,block", [(300, 50), (1000, 100), (1 << 20, 1 << 20)])
def test_files_by_ranges(spark, tmp_path, monkeypatch, split, block):
    monkeypatch.setattr(fastq, "READ", block)
    one, two = reads(2, 120), reads(3, 7, 3000)
    paths = [write(tmp_path / "a.fastq", one), write(tmp_path / "b.fastq", two, last=False), write(tmp_path / "none.fastq", [])]
    (tmp_path / "none.fastq").write_bytes(b"")
    packed = str(tmp_path / "c.fastq.gz")
    with gzip.open(packed, "wb") as out:
        out.write(open(paths[0], "rb").read())
    found = {}
    for r in fastq.read_fastq(spark, [*paths, packed], split=split).orderBy("file", "ordinal").collect():
        found.setdefault(r["file"], []).append((r["ordinal"], r["read_id"], r["seq"], r["qual"]))
    numbered = lambda rows: [(k, *r) for k, r in enumerate(rows, 1)]
    assert found == {paths[0]: numbered(one), paths[1]: numbered(two), packed: numbered(one)}
    listed = fastq.read_fastq_text(spark, str(tmp_path / "*"), split=split)
    assert sorted(map(tuple, listed.drop("file").collect())) == sorted(numbered(one) * 2 + numbered(two))


def test_a_plain_pair_is_read_by_many_tasks_without_a_shuffle_of_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fastq, "READ", 400)
    one = reads(4, 400)
    two = [(f"{name.split()[0]}/2", seq[:9] * 3, qual[:9] * 3) for name, seq, qual in one]
    manifest = spark.createDataFrame([("s", write(tmp_path / "1.fastq", one), write(tmp_path / "2.fastq", two))], "sample string, r1 string, r2 string")
    pairs = fastq.read_fastq_pairs(spark, manifest, split=2000)
    tasks = pairs.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 10
    got = [tuple(r) for r in pairs.orderBy("ordinal").collect()]
    assert got == [("s", k, a[0].split()[0], a[1], a[2], b[1], b[2]) for k, (a, b) in enumerate(zip(one, two), 1)]
    # Only the table of ranges, of a few numbers and paths, is shuffled.
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "seq" not in plan[plan.index("Exchange") :]


def test_uneven_mates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fastq, "READ", 100)
    one = reads(5, 50)
    short = [(n, "A", "I") for n, _, _ in one]
    pair = lambda a, b: spark.createDataFrame([("s", write(tmp_path / "1.fastq", a), write(tmp_path / "2.fastq", b))], "sample string, r1 string, r2 string")
    assert fastq.read_fastq_pairs(spark, pair(one, short), split=150).count() == 50
    assert fastq.read_fastq_pairs(spark, pair(short, one), split=150).count() == 50
    with pytest.raises(ContractError, match="numbers of records"):
        fastq.read_fastq_pairs(spark, pair(one, short[:-1]), split=150)
    wrong = [*short[:30], ("other", "A", "I"), *short[31:]]
    with pytest.raises(PySparkException, match="differ in name"):
        fastq.read_fastq_pairs(spark, pair(one, wrong), split=150).collect()


@pytest.mark.parametrize("text,message", [("@a\nA\n+\n", "inside a record"), ("a\nA\n+\nI\n", "lacks its '@'"), ("@a\nA\nx\nI\n", "lacks its '\\+'"), ("@a\nAC\n+\nI\n", "differ in number")])
def test_faults(spark, tmp_path, text, message):
    with gzip.open(tmp_path / "x.fastq.gz", "wb") as out:
        out.write(text.encode())
    with pytest.raises(PySparkException, match=message):
        fastq.read_fastq(spark, [str(tmp_path / "x.fastq.gz")]).collect()


def test_names():
    given = pa.chunked_array([["a/1 x", "b/2", "c", " d/1\ty", "/1", "", "e/3", "f/1/2"]])
    assert fastq.plain_ids(given).to_pylist() == ["a", "b", "c", "d", "", "", "e/3", "f/1"]
