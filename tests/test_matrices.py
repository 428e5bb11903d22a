import gzip
import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.contracts import ContractError
from seqlattice.operators import counts as C
from seqlattice.operators import ordering as O
from seqlattice.operators import qc as Q
from seqlattice.operators.graph import connected_components
from seqlattice.plans import expression, raw_qc
from seqlattice.sources import tables, writers

COUNTS = "gene string, cell string, count long"


def put_counts(folder, sample, lines):
    target = folder / sample
    target.mkdir(parents=True, exist_ok=True)
    path = target / f"{sample}_counts.tsv.gz"
    with gzip.open(path, "wt") as handle:
        handle.write("gene\tcell\tcount\n" + "".join(f"{line}\n" for line in lines))
    return str(path)


@pytest.fixture()
def small(spark, tmp_path):
    paths = [put_counts(tmp_path, "cell_b", ["gene_a\tcell_b\t2"]), put_counts(tmp_path, "cell_a", ["gene_b\t cell_a \t3"])]
    manifest = spark.createDataFrame([("cell_b", 1), ("cell_a", 2)], "sample string, ordinal long")
    annotation = spark.createDataFrame([("gene_a", "GENE_A", "test"), ("gene_b", "GENE_B", "test")], "gene_id string, gene_name string, gene_type string")
    return expression.build_dataset(tables.read_umi_counts(spark, paths), manifest, annotation), manifest


@pytest.mark.parametrize("single_file", [True, False])
def test_aggregation_keeps_manifest_order(spark, tmp_path, small, as_rows, single_file):
    data, manifest = small
    out = str(tmp_path / "out")
    writers.write_mtx(data, out, manifest, single_file=single_file)
    lines = [r["value"] for r in spark.read.text(f"{out}/matrix.mtx").collect()]
    assert sorted(lines, key=lambda v: not v.startswith("%")) == ["%%MatrixMarket matrix coordinate integer general", "2 2 2", "1 1 2", "2 2 3"]
    entries, genes, cells = tables.read_mtx(spark, f"{out}/matrix.mtx", f"{out}/features.tsv", f"{out}/barcodes.tsv")
    assert as_rows(entries, "i") == [(1, 1, 2), (2, 2, 3)]
    assert [r["cell"] for r in cells.orderBy("ordinal").collect()] == ["cell_b", "cell_a"]
    assert as_rows(genes, "ordinal") == [(1, "gene_a", "GENE_A", "test"), (2, "gene_b", "GENE_B", "test")]
    writers.write_wide_counts(data.counts, f"{out}/wide", ["cell_b", "cell_a"])
    wide = spark.read.csv(f"{out}/wide", sep="\t", header=True)
    assert wide.columns == ["gene_id", "cell_b", "cell_a"]
    assert as_rows(wide, "gene_id") == [("gene_a", "2", "0"), ("gene_b", "0", "3")]


@pytest.mark.parametrize("line", ["g\tcell_a\t1.5", "g\tcell_a\t-1", "g\tcell_a\tx", "g\tother\t1", "\tcell_a\t1", "g\tcell_a\tNaN"])
def test_bad_counts_are_rejected(spark, tmp_path, line):
    with pytest.raises(ContractError):
        tables.read_umi_counts(spark, [put_counts(tmp_path, "cell_a", [line])])


def test_zero_matrix_is_rejected(spark, small):
    data, manifest = small
    with pytest.raises(ContractError):
        expression.build_dataset(data.counts.withColumn("count", F.lit(0)), manifest, data.features.drop("gene"))


def test_feature_filter_and_names(spark, as_rows):
    entries = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 2), (2, 2, 2), (3, 1, 3)], "i long, j long, x long")
    features = spark.createDataFrame([(1, "gene_1", "a", "t"), (2, "gene2", "b", "t"), (3, "gene3", "c", "t")], "ordinal long, gene_id string, gene_name string, gene_type string")
    cells = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "ordinal long, cell string")
    metadata = spark.createDataFrame([("x", "p"), ("y", "q"), ("z", "q"), ("extra", "r")], "sample string, batch string")
    data = C.CellDataset.from_matrix(entries, features, cells, min_cells=2, metadata=metadata)
    assert as_rows(data.features.select("gene", "gene_id"), "ordinal") == [("gene-1", "gene_1"), ("gene2", "gene2")]
    assert data.counts.count() == 5 and set(data.cells.columns) == {"ordinal", "cell", "sample_id", "batch"}
    with pytest.raises(ContractError):
        data.with_cell_metadata(metadata.filter("sample <> 'x'").withColumnRenamed("batch", "other"))
    with pytest.raises(ContractError):
        data.with_cell_metadata(metadata)
    fewer = C.CellDataset.from_matrix(entries, features, cells, min_features=2)
    assert {r["cell"] for r in fewer.cells.collect()} == {"x", "y"}


def plain_unique(names):
    seen, given, out = defaultdict(int), set(names), []
    first = set()
    for name in names:
        if name not in first:
            first.add(name)
            out.append(name)
            continue
        seen[name] += 1
        while f"{name}.{seen[name]}" in given:
            seen[name] += 1
        out.append(f"{name}.{seen[name]}")
    return out


@pytest.mark.parametrize("names", [["x", "x", "x.1", "x", "y", "x.3", "x", "x.1", "x.01", "x"], ["a"] * 50 + ["a.7", "b"], ["a_b", "a-b", "a_b"]])
def test_unique_names(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "ordinal long, name string").repartition(3)
    got = [r["u"] for r in C.make_unique(df, "name", "ordinal", "u").orderBy("ordinal").collect()]
    assert got == plain_unique(names)


def test_collapse_merge_and_round_trip(spark, tmp_path, as_rows):
    one = C.CellDataset.from_counts(spark.createDataFrame([("g1", "c", 1), ("g2", "c", 2), ("g3", "c", 4), ("g4", "c", 0)], COUNTS))
    names = spark.createDataFrame([("g1", "A"), ("g2", "A"), ("g3", "")], "gene string, gene_name string")
    assert as_rows(C.collapse_features(one.counts, names)) == [("A", "c", 3)]
    merged = C.merge_datasets({"d1": one, "d2": one}, {"d1": "x", "d2": "y"})
    assert {r["cell"] for r in merged.counts.collect()} == {"d1_c", "d2_c"} and merged.features.count() == 4
    merged.write(str(tmp_path / "ds"))
    back = C.CellDataset.read(spark, str(tmp_path / "ds"))
    assert back.counts.count() == 6 and back.cells.count() == 2
    candidates = spark.createDataFrame([("c", 1)], "sample string, candidate int")
    assert {r["fusion_candidate"] for r in C.attach_candidates(merged, candidates, "x").cells.collect()} == {1}
    with pytest.raises(ContractError):
        C.attach_candidates(merged, candidates.filter("false"), "x")


def directional(counts):
    """Breadth-first clusters from the most frequent UMI down."""
    order = sorted(counts, key=lambda u: (-counts[u], u))
    found, clusters = set(), 0
    for root in order:
        if root in found:
            continue
        clusters += 1
        stack = [root]
        while stack:
            a = stack.pop()
            if a in found:
                continue
            found.add(a)
            stack += [b for b in counts if sum(x != y for x, y in zip(a, b)) == 1 and counts[a] >= 2 * counts[b] - 1]
    return clusters


@pytest.mark.parametrize("max_edges", [500_000, 20])
def test_directional_equals_brute_force(spark, max_edges):
    rnd = random.Random(1)
    reads = []
    for cell, gene in itertools.product(range(4), range(3)):
        for _ in range(rnd.choice([5, 60, 150])):
            umi = "".join(rnd.choice("ACGT"[: 2 + gene]) for _ in range(4))
            reads += [(f"c{cell}", f"g{gene}", umi)] * rnd.choice([1, 1, 1, 2, 5])
    # One group with a third of all reads.
    reads += [("hot", "g", "".join(rnd.choice("ACGT") for _ in range(4))) for _ in range(len(reads) // 2)]
    reads += [("fix", "g", "GTATCACG")] * 57 + [("fix", "g", "GTCTCACG")]
    df = spark.createDataFrame(reads, "CB string, gene_id string, UB string")
    groups = defaultdict(Counter)
    for cell, gene, umi in reads:
        groups[(gene, cell)][umi] += 1
    got = {(r["gene"], r["cell"]): r["count"] for r in C.dedup_umis(df, method="directional", max_edges=max_edges).collect()}
    assert got == {key: directional(c) for key, c in groups.items()} and got[("g", "fix")] == 1
    unique = {(r["gene"], r["cell"]): r["count"] for r in C.dedup_umis(df).collect()}
    assert unique == {key: len(c) for key, c in groups.items()} and unique[("g", "fix")] == 2
    with pytest.raises(ContractError):
        C.dedup_umis(df, method="adjacency")


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (200, 100), (300, 300)] + [(500, k) for k in range(501, 540)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[200] == 100 and {got[k] for k in range(500, 540)} == {500}
    assert 300 not in got


@pytest.mark.parametrize("parts", [1, 7])
def test_ordering_on_skewed_groups(spark, parts):
    rnd = random.Random(3)
    data = [("hot", 5.0) if i % 3 == 0 else (rnd.choice("ab"), float(rnd.randint(0, 30))) for i in range(900)]
    data += [("hot", float(i)) for i in range(50)]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "id long, g string, v double").repartition(parts)
    by = defaultdict(list)
    for g, v in data:
        by[g].append(v)
    for r in O.average_rank(df, ["g"], "v", "r").collect():
        less, same = sum(x < r["v"] for x in by[r["g"]]), sum(x == r["v"] for x in by[r["g"]])
        assert r["r"] == less + (same + 1) / 2
    for r in O.quantiles(df, ["g"], "v", {"q1": 0.25, "q9": 0.9, "one": 1.0}).collect():
        assert [r["q1"], r["q9"], r["one"]] == pytest.approx(list(np.quantile(by[r["g"]], [0.25, 0.9, 1.0])))
    numbered = O.row_numbers(df, ["g"], ["v", "id"], "n", total="size").collect()
    for g, values in by.items():
        mine = sorted((r["n"], r["v"], r["id"]) for r in numbered if r["g"] == g)
        assert [m[0] for m in mine] == list(range(1, len(values) + 1))
        assert mine == sorted(mine, key=lambda m: m[1:])
        assert {r["size"] for r in numbered if r["g"] == g} == {len(values)}


def test_benjamini_hochberg(spark):
    rnd = random.Random(5)
    p = [round(rnd.random() ** 2, 2) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double").repartition(6)
    got = {r["id"]: r["q"] for r in O.benjamini_hochberg(df, "p", "q").collect()}
    order = sorted(range(200), key=lambda i: -p[i])
    low, wanted = 1.0, {}
    for k, i in enumerate(order):
        low = min(low, p[i] * 200 / (200 - k))
        wanted[i] = low
    assert got == pytest.approx(wanted)


def test_raw_qc_goldens(spark, tmp_path, as_rows):
    table = [("A", 100, 100), ("B", 478877, 12149), ("C", 478878, 12150), ("D", 900000, 20000)]
    summaries, paths = [], []
    for sample, assigned, umis in table:
        paths.append(put_counts(tmp_path, sample, [f"g\t{sample}\t{umis}"]))
        target = tmp_path / sample / f"{sample}_gene_assigned.txt.summary"
        target.write_text(f"Status\tx.bam\nAssigned\t7\nUnassigned\t1\nAssigned\t{assigned}\n")
        summaries.append(str(target))
    manifest = spark.createDataFrame([(t[0],) for t in table], "sample string")
    assigned = tables.read_assignment_summary(spark, summaries, r"_gene_assigned\.txt\.summary")
    result = raw_qc.run(manifest, assigned, tables.read_umi_counts(spark, paths))
    got = as_rows(result.samples.select("sample", "assigned_read_pass", "deduplicated_umi_pass", "raw_qc_keep", "raw_qc_status"), "sample")
    assert got == [("A", 1, 1, 1, "keep"), ("B", 1, 1, 1, "keep"), ("C", 0, 0, 0, "raw_qc_removal"), ("D", 0, 0, 0, "raw_qc_removal")]
    values = {r["parameter"]: r["value"] for r in result.parameters.collect()}
    assert values["empirical_assigned_read_percentile_value"] == "478877.95"
    assert values["empirical_deduplicated_umi_percentile_value"] == "12935"
    assert (values["retained_sample_count"], values["removed_sample_count"]) == ("2", "2")
    with pytest.raises(ContractError):
        raw_qc.run(manifest, assigned.filter("sample <> 'A'"), tables.read_umi_counts(spark, paths))


def test_read_tracking_views(spark):
    manifest = spark.createDataFrame([("A",), ("B",)], "sample string")
    records = spark.createDataFrame([("A", "raw_umi", 1), ("A", "raw_umi", 2), ("A", "trimmed_umi", 1)], "sample string, step string, mate int")
    alignments = spark.createDataFrame(
        [("A", 0, "chr1", "Assigned", "A", "U", "g"), ("A", 0, "mouse_chr1", "Assigned", "A", "U", "g"), ("A", 0, "chr1", None, "A", "U", "g"),
         ("A", 4, "*", "Assigned", "A", "V", "g")],
        "sample string, flag int, rname string, XS string, CB string, UB string, XT string",
    )
    counts = spark.createDataFrame([("g", "A", 5)], COUNTS)

    def view(legacy):
        table = Q.read_tracking(Q.record_counts(records), alignments, counts, manifest, legacy)
        return {(r["sample"], r["step"]): r["value"] for r in table.collect()}

    old, new = view(True), view(False)
    assert (old["A", "raw_umi"], new["A", "raw_umi"], old["A", "trimmed_umi"], new["A", "trimmed_umi"]) == ("2", "1", "1", "1")
    assert new["A", "reads_human_Assigned"] == "1" and new["A", "reads_human_Unassigned_Other"] == "1"
    assert new["A", "Percent_Human_Assigned"] == "50.00%" and ("B", "Percent_Human_Assigned") not in new
    assert (new["A", "Tagged_Reads"], new["A", "UMIs_tagged"], new["A", "UMIs_deduplicated"]) == ("3", "2", "5")
    assert (new["B", "Tagged_Reads"], new["B", "UMIs_deduplicated"], new["B", "raw_umi"]) == ("0", "0", "0")


def test_molecules_from_alignments(spark, as_rows):
    sam = spark.createDataFrame(
        [("f", i, f"r{i}|CB:c|UB:{u}", 3, "chr1", p, 255, "5M", {"NH": "1"}) for i, (u, p) in enumerate([("AA", 10), ("AA", 11), ("CC", 10), ("CC", 90)])],
        "file string, ordinal long, qname string, flag int, rname string, pos long, mapq int, cigar string, tags map<string,string>",
    )
    exons = spark.createDataFrame([("chr1", 1, 20, "BCR"), ("chr1", 80, 99, "ABL1")], "chrom string, start long, end long, gene_id string")
    got = expression.count_molecules(expression.tag_alignments(sam), exons)
    assert as_rows(got, "gene") == [("ABL1", "c", 1), ("BCR", "c", 2)]


def test_file_hashes(spark, tmp_path, as_rows):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("abc")
    (tmp_path / "d" / "sub" / ".hidden").write_text("")
    inputs = spark.createDataFrame([(1, "x", str(tmp_path / "d")), (2, "y", str(tmp_path / "d" / "a.txt"))], "ordinal long, dataset string, path string")
    got = as_rows(tables.hash_files(spark, inputs).drop("input_path"), "manifest_row", "relative_file")
    abc, empty = hashlib.sha256(b"abc").hexdigest(), hashlib.sha256(b"").hexdigest()
    assert got == [(2, "x", "a.txt", 3, abc), (2, "x", "sub/.hidden", 0, empty), (3, "y", ".", 3, abc)]
    with pytest.raises(ContractError):
        tables.hash_files(spark, inputs.withColumn("path", F.lit("/no/such/path")))


def test_mtx_size_mismatch(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 1 1\n1 1 3\n")
    (tmp_path / "f.tsv").write_text("g1\tn1\tGene Expression\ng2\tn2\tOther\n")
    (tmp_path / "b.tsv").write_text("c\n")
    args = [str(tmp_path / n) for n in ("m.mtx", "f.tsv", "b.tsv")]
    assert [d.count() for d in tables.read_mtx(spark, *args, modality="Gene Expression")] == [1, 1, 1]
    (tmp_path / "b.tsv").write_text("c\nd\n")
    with pytest.raises(ContractError):
        tables.read_mtx(spark, *args)
