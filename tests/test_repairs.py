"""Answers that were wrong once: lines under other splits, part folders, nulls, centred scores, missing samples, subsets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.contracts import ContractError
from seqlattice.operators import embedding as E
from seqlattice.operators import ordering
from seqlattice.operators import reads as R
from seqlattice.operators.counts import CellDataset
from seqlattice.operators.markers import log_normalize
from seqlattice.plans import expression, raw_qc
from seqlattice.sources import tables, text, writers


def test_lines_keep_their_numbers_when_splits_change(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(30_000)))
    key = "spark.sql.files.minPartitionNum"
    spark.conf.set(key, 2)
    try:
        lines = text.read_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
        spark.conf.set(key, 24)
        found = lines.select(F.regexp_extract("file", r"([ab])\.txt", 1).alias("f"), "line_no", "value").collect()
    finally:
        spark.conf.unset(key)
    assert sorted(map(tuple, found)) == sorted((n, i + 1, f"{n}{i}") for n in ("a", "b") for i in range(30_000))


def test_blank_junction_lines_are_malformed_and_empty_ones_skipped(spark):
    lines = spark.createDataFrame([("s", 1, ""), ("s", 2, "  "), ("s", 3, "  # note"), ("s", 4, "x\t1")], "sample string, line_no long, value string")
    assert [(r["source_line"], r["malformed"]) for r in text.parse_junctions(lines).collect()] == [(2, True), (4, True)]


def test_matrix_in_many_parts(spark, tmp_path):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    rng = np.random.default_rng(1)
    rows = [(f"g{i:03d}", f"c{j:02d}", int(v)) for i in range(40) for j, v in enumerate(rng.poisson(2, 12))]
    data = CellDataset.from_counts(spark.createDataFrame(rows, "gene string, cell string, count long"))
    spark.conf.set(key, "false")
    try:
        writers.write_mtx(data, str(tmp_path / "m"))
    finally:
        spark.conf.unset(key)
    assert len(list((tmp_path / "m" / "features.tsv").glob("part-*"))) > 1
    entries, genes, cells = tables.read_mtx(spark, *[str(tmp_path / "m" / n) for n in ("matrix.mtx", "features.tsv", "barcodes.tsv")])
    named = entries.join(genes.select(F.col("ordinal").alias("i"), "gene_id"), "i").join(cells.select(F.col("ordinal").alias("j"), "cell"), "j")
    assert sorted((r["gene_id"], r["cell"], r["x"]) for r in named.collect()) == sorted(r for r in rows if r[2])


def test_null_p_values_count_for_nothing(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, None), (4, 0.5)], "i int, p double")
    got = {r["i"]: r["fdr"] for r in ordering.benjamini_hochberg(df, "p", "fdr").collect()}
    assert got == {1: pytest.approx(0.03), 2: pytest.approx(0.03), 3: None, 4: pytest.approx(0.5)}


def test_null_values_have_no_rank(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", None), ("a", 2.0), (None, 1.0), (None, None)], "g string, v double")
    got = sorted((str(r["g"]), str(r["v"]), r["r"]) for r in ordering.average_rank(df, ["g"], "v", "r").collect())
    assert got == [("None", "1.0", 1.0), ("None", "None", None), ("a", "2.0", 1.5), ("a", "2.0", 1.5), ("a", "None", None)]


def test_scores_are_centred_and_link_the_right_cells(spark):
    rng = np.random.default_rng(3)
    counts = rng.poisson(rng.uniform(0.5, 6, 12)[:, None] * rng.uniform(0.5, 2, (12, 30)))
    rows = [(f"g{j:02d}", f"c{i:02d}", int(counts[j, i])) for j in range(12) for i in range(30) if counts[j, i]]
    data = CellDataset.from_counts(spark.createDataFrame(rows, "gene string, cell string, count long"))
    top = E.variable_features(data, 12)
    scaled = E.scale_genes(log_normalize(data.counts), top.select("gene", "rank"), 30)
    pcs = E.principal_components(scaled, data.cells, 12, 3)
    mine = np.array([r["pcs"] for r in pcs.orderBy("cell").collect()])
    assert np.abs(mine.mean(axis=0)).max() < 1e-9
    dense = np.zeros((30, 12))
    rank = {r["gene"]: r["rank"] - 1 for r in top.collect()}
    for r in scaled.select("gene", "z0").distinct().collect():
        dense[:, rank[r["gene"]]] = r["z0"]
    for r in scaled.collect():
        dense[int(r["cell"][1:]), rank[r["gene"]]] = r["z"]
    u, d, _ = np.linalg.svd(dense - dense.mean(axis=0), full_matrices=False)
    true = (u * d)[:, :3]
    assert np.allclose(np.abs(mine), np.abs(true), atol=1e-6)
    unit = true / np.linalg.norm(true, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    want = {(f"c{i:02d}", f"c{j:02d}") for i in range(30) for j in np.argsort(-cosine[i])[:5]}
    graph = E.knn_cosine(pcs.select("cell", F.col("pcs").alias("vector")), 5, key="cell")
    ends = [c for c in graph.columns if c in ("cell", "neighbor")]
    assert {tuple(r[c] for c in ends) for r in graph.collect()} == want


def test_missing_samples_are_errors(spark):
    manifest = spark.createDataFrame([("a", 1), ("b", 2)], "sample string, ordinal long")
    assigned = spark.createDataFrame([("a", 5), ("b", 6)], "sample string, featurecounts_assigned long")
    counts = spark.createDataFrame([("g", "a", 3)], "gene string, cell string, count long")
    names = spark.createDataFrame([("g", "G", "t")], "gene_id string, gene_name string, gene_type string")
    with pytest.raises(ContractError):
        raw_qc.run(manifest, assigned, counts)
    with pytest.raises(ContractError):
        expression.build_dataset(counts, manifest, names)
    kept = raw_qc.run(manifest, assigned, counts, tables=manifest).samples
    assert sorted((r["sample"], r["total_deduplicated_umis"]) for r in kept.collect()) == [("a", 3), ("b", 0)]
    assert expression.build_dataset(counts, manifest, names, tables=manifest).cells.count() == 2


def test_subset_of_each_sample(spark):
    df = spark.createDataFrame([(s, i, f"read{i}") for s in "xy" for i in range(20)], "sample string, ordinal long, read_id string")
    got = R.bottom_k(df, "read_id", 5, 3, by=["sample"]).collect()
    assert sorted((r["sample"], r["output_index"]) for r in got) == [(s, k) for s in "xy" for k in range(1, 6)]
    with pytest.raises(ContractError):
        R.bottom_k(df, "read_id", 21, 3, by=["sample"])


def test_tracking_from_files(spark, tmp_path):
    import gzip

    from seqlattice.plans import read_tracking

    def put(path, text):
        path.parent.mkdir(parents=True, exist_ok=True)
        with gzip.open(path, "wt") as out:
            out.write(text)

    reads = lambda n: "".join(f"@r{i}\nAC\n+\nII\n" for i in range(n))
    for sample, n in (("b", 3), ("a", 2)):
        put(tmp_path / "umi_extracted" / sample / f"{sample}_R1_umi_out.fastq.gz", reads(n))
        put(tmp_path / "umi_extracted" / sample / f"{sample}_R2_umi_out.fastq.gz", reads(n))
        put(tmp_path / "umi_trimmed" / sample / f"{sample}_R1_umi_out_val_1.fq.gz", reads(n - 1))
        line = lambda i, xs: f"r{i}\t0\tchr1\t5\t255\t2M\t*\t0\t0\tAC\tII\tCB:Z:{sample}\tUB:Z:U{i}\tXS:Z:{xs}\tXT:Z:g\n"  # noqa: B023, E731
        place = tmp_path / "mapped" / sample
        put(place / f"{sample}_assigned_sorted.sam.gz", "@HD\tVN:1.6\n" + line(1, "Assigned") + line(2, "Assigned") + line(3, "Unassigned_NoFeatures"))
        put(place / f"{sample}_counts.tsv.gz", f"gene\tcell\tcount\ng\t{sample}\t{n}\n")
    manifest = spark.createDataFrame([("b", 1), ("a", 2)], "sample string, ordinal long")
    result = read_tracking.run(spark, manifest, str(tmp_path))
    result.write(str(tmp_path / "out"))
    lines = lambda name: [line.split("\t") for p in (tmp_path / "out" / name).glob("part-*") for line in p.read_text().splitlines()]
    legacy, corrected = lines("readtracking_production_legacy"), lines("readtracking_corrected_r1")
    assert legacy[:5] == [["sample", "step", "value"], ["b", "raw_umi", "6"], ["b", "raw_noumi", "0"], ["b", "trimmed_umi", "2"], ["b", "trimmed_noumi", "0"]]
    assert corrected[1] == ["b", "raw_umi", "3"] and [r[0] for r in corrected[1:]] == sorted([r[0] for r in corrected[1:]], reverse=True)
    assert ["a", "Tagged_Reads", "2"] in corrected and ["a", "UMIs_tagged", "2"] in corrected and ["a", "UMIs_deduplicated", "2"] in corrected
    with pytest.raises(ContractError):
        read_tracking.run(spark, manifest.union(spark.createDataFrame([("c", 3)], manifest.schema)), str(tmp_path))


def test_functions_find_the_package_from_any_folder(spark, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"import sys; sys.path.insert(0, {str(root)!r})\n" + (
        "from seqlattice import build_session\n"
        "from seqlattice.operators import reads as R\n"
        "spark = build_session('local[2]', {'spark.ui.enabled': 'false'})\n"
        "df = spark.createDataFrame([(1, 'a'), (2, 'b')], 'ordinal long, read_id string')\n"
        "assert R.bottom_k(df, 'read_id', 1, 3).count() == 1\n"
    )
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=240, capture_output=True)


def test_fastq_roundtrip_writes_whole_texts(spark, tmp_path, monkeypatch):
    from workload import roundtrips

    rows = [(1, "short one", "aa"), (2, "ab\ncd" * 300, "aa"), (3, "x" * 150_000 + "é\r\n🙂", "bb")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    places = []
    monkeypatch.setattr(roundtrips, "_folder", lambda spark: places.append(str(tmp_path / f"files{len(places)}")) or places[-1])
    first = sorted(map(tuple, roundtrips.fastq_roundtrip(spark, str(tmp_path)).collect()))
    lengths = sorted(r[0] for r in spark.read.text(f"{places[0]}/*/*").filter("value NOT LIKE '+%' AND value NOT LIKE '@%'").select(F.length("value")).collect())
    assert lengths == sorted(2 * [len(t) for _, t, _ in rows])
    assert first == [("aa", 2, 1509, 2), ("bb", 1, 150_004, 1)]
    whole = sorted(map(tuple, roundtrips.fastq_whole_roundtrip(spark, str(tmp_path)).collect()))
    assert whole == [("aa", 2, 1509, 301, 1500, 2), ("bb", 1, 150_004, 4, 150_004, 1)]


def test_rows_of_a_table_are_numbered_by_file_name_whatever_the_sizes(spark, tmp_path):
    """The scan reads the largest file first."""
    at = 0
    for part, rows in enumerate([3, 4000, 1, 900, 2]):
        (tmp_path / f"part-{part:05d}.tsv").write_text("sample\tcondition\n" + "".join(f"s{at + i}\t{'AB'[i % 2]}\n" for i in range(rows)))
        at += rows
    table = tables.read_table(spark, str(tmp_path), ordinal=True)
    assert table.columns == ["sample", "condition", "ordinal"]
    assert table.filter(F.col("sample") != F.concat(F.lit("s"), F.col("ordinal") - 1)).count() == 0
    assert table.count() == at


def test_lines_of_a_folder_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from workload import check, roundtrips

    place = tmp_path / "files"
    monkeypatch.setattr(roundtrips, "_folder", lambda spark: str(place))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        folder = "/root/testdata/sf0.001"
        ok, text = check.compare(spark, folder, check.connect(folder), roundtrips.lines_roundtrip, roundtrips.ORACLES["lines_roundtrip"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ok, text
    assert max(len(list(part.glob("part-*"))) for part in place.iterdir() if part.is_dir()) > 1
