import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.contracts import ContractError
from seqlattice.functions.tails import incomplete_beta, tail_p
from seqlattice.operators import bulk as B
from seqlattice.operators import embedding as E
from seqlattice.operators import markers as M
from seqlattice.operators import signature as S
from seqlattice.operators.counts import CellDataset
from seqlattice.plans import concordance, joint_embedding
from seqlattice.schemas import Contrast
from seqlattice.sources import tables

RS = Contrast("resistant", "sensitive")

# Bulk counts (3 + 3 libraries), pre-computed logFC (to be negated), P, FDR, cell counts (4 + 4 + 2).
GENES = {
    "GENEA1": ([500, 550, 480, 50, 45, 55], -4, 1e-6, 1e-5, [50, 45, 55, 48, 5, 4, 6, 5, 8, 7]),
    "GENEA2": ([250, 270, 240, 30, 25, 35], -3, 2e-6, 2e-5, [25, 24, 28, 26, 3, 2, 4, 3, 6, 5]),
    "GENEB1": ([45, 50, 40, 500, 520, 480], 4, 1e-6, 1e-5, [4, 5, 3, 4, 50, 48, 55, 52, 7, 8]),
    "GENEB2": ([25, 30, 20, 250, 260, 240], 3, 2e-6, 2e-5, [2, 3, 2, 2, 25, 24, 28, 26, 5, 6]),
    "GENESTABLE1": ([300, 310, 290, 300, 310, 290], 0, 0.9, 0.9, [30, 31, 29, 30, 30, 31, 29, 30, 25, 24]),
    "GENESTABLE2": ([100, 110, 90, 100, 110, 90], 0, 0.9, 0.9, [10, 11, 9, 10, 10, 11, 9, 10, 12, 13]),
    "MT-FIXTURE": ([800, 850, 780, 80, 85, 75], -5, 1e-7, 1e-6, [80, 85, 78, 82, 8, 9, 7, 8, 4, 5]),
    "RPL-FIXTURE": ([70, 75, 65, 700, 710, 690], 5, 1e-7, 1e-6, [7, 8, 6, 7, 70, 72, 68, 71, 6, 5]),
}
CELLS = [f"R{i}" for i in range(1, 5)] + [f"S{i}" for i in range(1, 5)] + ["PBMC1", "PBMC2"]
SAMPLES = ["r1", "r2", "r3", "s1", "s2", "s3"]


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("concordance")
    head = "gene_id\tgene_name\tgene_biotype\t" + "\t".join(f"{s}_count" for s in SAMPLES)
    body = [f"ENS{i}\t{g}\tcoding\t" + "\t".join(map(str, v[0])) for i, (g, v) in enumerate(GENES.items())]
    (folder / "bulk.tsv").write_text("\n".join([head, *body]) + "\n")
    (folder / "samples.tsv").write_text("sample\tcondition\n" + "".join(f"{s}\t{'resistant' if s[0] == 'r' else 'sensitive'}\n" for s in SAMPLES))
    de = ["EnsemblID,gene_name,gene_biotype,logFC,PValue,FDR"] + [f"ENS{i},{g},coding,{v[1]},{v[2]},{v[3]}" for i, (g, v) in enumerate(GENES.items())]
    (folder / "de.csv").write_text("\n".join(de) + "\n")
    rows = [(f"f_{g}", c, n) for g, v in GENES.items() for c, n in zip(CELLS, v[4], strict=True)]
    rows += [("f_GENEA1", "DROPPED", 5)]
    counts = spark.createDataFrame(rows, "gene string, cell string, count long")
    features = spark.createDataFrame([(f"f_{g}", g) for g in GENES], "gene string, gene_name string")
    label = {"R": "resistant", "S": "sensitive", "P": "PBMC"}
    cells = spark.createDataFrame([(c, label[c[0]], " TRUE") for c in CELLS] + [("DROPPED", "resistant", "no")], "cell string, condition string, analysis_keep string")
    samples = tables.read_bulk_samples(spark, str(folder / "samples.tsv"), RS)
    bulk, genes = tables.read_bulk_matrix(spark, str(folder / "bulk.tsv"), SAMPLES, suffix="_count")
    de_table = tables.read_de_table(spark, str(folder / "de.csv"), multiplier=-1.0)
    return folder, bulk, genes, samples, CellDataset.from_counts(counts, features, cells), de_table


def settings(**changes):
    base = dict(contrast=RS, top_n=2, exclude_regex="^MT-|^RPL|^RPS", ctrl=2, nbin=2, keep_column="analysis_keep", feature_column="gene_name")
    return concordance.Settings(**{**base, **changes})


def test_concordance_fixture(spark, inputs, as_rows, tmp_path):
    _, bulk, genes, samples, data, de = inputs
    result = concordance.run(bulk, genes, samples, data, settings(), de)
    top = as_rows(result["bulk_top_genes"].select("signature", "rank_within_direction", "gene"), "signature", "rank_within_direction")
    assert top == [("condition_a_high", 1, "GENEA1"), ("condition_a_high", 2, "GENEA2"), ("condition_b_high", 1, "GENEB1"), ("condition_b_high", 2, "GENEB2")]
    metrics = {r["scope"]: r for r in result["concordance_metrics"].collect()}
    chosen = metrics["selected_genes_combined"]
    assert chosen["n_genes"] == 4 and chosen["direction_concordance"] == 1.0
    assert chosen["pearson_r"] >= 0.95 and chosen["spearman_rho"] >= 0.8 and 0 < chosen["pearson_p_value"] < 0.05
    assert metrics["selected_condition_a_high"]["n_genes"] == 2 and metrics["selected_condition_a_high"]["pearson_r"] is None
    groups = {r["condition"]: r["retained_cells"] for r in result["single_cell_group_summary"].collect()}
    assert groups == {"resistant": 4, "sensitive": 4}
    assert result["single_cell_resistance_scores"].count() == 10
    scores = as_rows(result["resistance_score_group_summary"].select("condition", "n_samples", "mean_resistance_score"), "level", "condition")
    assert [s[:2] for s in scores] == [("sensitive", 4), ("resistant", 4), ("PBMC", 2)] and scores[1][2] > scores[0][2]
    tested = {r["gene"]: r for r in result["bulk_all_tested_genes"].collect()}
    assert len(tested) == 8 and min(tested.values(), key=lambda r: r["PValue"])["gene"] != "ENS4"
    assert result["volcano"].filter("display_group = 'Selected resistant-high'").count() == 2
    assert result["dot_plot"].count() == 8 and result["concordance_plot"].count() == 8
    values = {r["parameter"]: r["value"] for r in result["analysis_parameters"].collect()}
    assert values["bulk_signature_source"] == "precomputed_bulk_de_table" and values["matched_gene_count"] == "8"
    result.write(str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out" / "concordance_metrics"), sep="\t", header=True).count() == 5
    parts = sorted((tmp_path / "out" / "bulk_top_genes").glob("part-*"))
    written = [line.split("\t") for part in parts for line in part.read_text().splitlines()]
    names = [row[written[0].index("gene")] for row in written if row != written[0]]
    assert names == [t[2] for t in top]
    with pytest.raises(ContractError, match="genes asked for"):
        S.select_signature(result["bulk_single_cell_matched_genes"], RS, 100)
    with pytest.warns(UserWarning):
        S.select_signature(result["bulk_single_cell_matched_genes"], RS, 100, require_full=False)
    with pytest.raises(ContractError, match="Nothing to select"):
        S.select_signature(result["bulk_single_cell_matched_genes"].filter("bulk_log2FC > 0"), RS, 1)
    big = S.select_signature(result["bulk_single_cell_matched_genes"], RS, 2000, check=False)
    assert big.count() == 6 and big.filter("rank_within_direction = 1").count() == 2


def test_bulk_contracts(spark, inputs, tmp_path):
    folder = inputs[0]
    with pytest.raises(ContractError):
        tables.read_bulk_samples(spark, str(folder / "samples.tsv"), RS, min_replicates=4)
    with pytest.raises(ContractError):
        tables.read_bulk_samples(spark, str(folder / "samples.tsv"), Contrast("resistant", "other"))
    with pytest.raises(ContractError):
        tables.read_de_table(spark, str(folder / "de.csv"), multiplier=0.0)
    with pytest.raises(ContractError):
        tables.read_bulk_matrix(spark, str(folder / "bulk.tsv"), [*SAMPLES, "r9"], suffix="_count")
    (tmp_path / "de.tsv").write_text("EnsemblID\tgene_name\tgene_biotype\tlogFC\tPValue\tFDR\nE\tG\tc\t1\t0.1\t1.5\n")
    with pytest.raises(ContractError):
        tables.read_de_table(spark, str(tmp_path / "de.tsv"))
    with pytest.raises(ValueError):
        Contrast("a", "a")


def test_keep_vocabulary(spark, inputs):
    data = inputs[4]
    odd = CellDataset(data.counts, data.features, data.cells.withColumn("analysis_keep", F.lit("perhaps")))
    with pytest.raises(ContractError):
        M.keep_cells(odd, "analysis_keep")


def dense_wilcoxon(a, b):
    both = list(a) + list(b)
    rank = [sum(v < x for v in both) + (sum(v == x for v in both) + 1) / 2 for x in both]
    n_a, n_b, n = len(a), len(b), len(both)
    u = sum(rank[:n_a]) - n_a * (n_a + 1) / 2
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    variance = n_a * n_b / 12 * (n + 1 - ties / (n * (n - 1)))
    if variance <= 1e-9:
        return u, None
    shift = u - n_a * n_b / 2
    z = (shift - math.copysign(0.5, shift) * (shift != 0)) / math.sqrt(variance)
    return u, math.erfc(abs(z) / math.sqrt(2))


def test_sparse_rank_test_equals_dense(spark):
    rnd = random.Random(2)
    cells = [(f"c{i}", "A" if i < 9 else "B" if i < 20 else "C") for i in range(25)]
    counts = [(f"g{j}", c, n) for j in range(12) for c, _ in cells if (n := rnd.choice([0, 0, 0, 1, 1, 2, 9]))] + [("pad", c, 5) for c, _ in cells]
    features = spark.createDataFrame([(f"g{j}",) for j in range(12)] + [("pad",), ("never",)], "gene string")
    data = CellDataset(spark.createDataFrame(counts, "gene string, cell string, count long"), features, spark.createDataFrame(cells, "cell string, condition string"))
    got = {r["gene"]: r for r in M.find_markers(data, Contrast("A", "B")).collect()}
    totals = {c: sum(n for _, d, n in counts if d == c) for c, _ in cells}
    value = {(g, c): round(math.log1p(n / totals[c] * 1e4), 12) for g, c, n in counts}
    for gene in [f"g{j}" for j in range(12)] + ["pad", "never"]:
        a = [value.get((gene, c), 0.0) for c, k in cells if k == "A"]
        b = [value.get((gene, c), 0.0) for c, k in cells if k == "B"]
        _, p = dense_wilcoxon(a, b)
        row = got[gene]
        assert row["p_val"] == (None if p is None else pytest.approx(p))
        assert row["pct_1"] == pytest.approx(sum(v > 0 for v in a) / len(a))
        effect = math.log2((sum(map(math.expm1, a)) + 1) / len(a)) - math.log2((sum(map(math.expm1, b)) + 1) / len(b))
        assert row["sc_log2FC"] == pytest.approx(effect)
        assert row["p_val_adj"] is None or row["p_val_adj"] == pytest.approx(min(1.0, p * 14))
    assert M.find_markers(data, Contrast("A", "B"), min_pct=1.0).count() < 14
    with pytest.raises(ContractError):
        M.find_markers(data, Contrast("A", "B"), test="t")


def test_tail_probabilities(spark):
    assert incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    assert incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)
    df = spark.createDataFrame([(1.959963984540054, 2.2281388519649385, 4.964602743730711), (0.0, 0.0, 0.0), (None, None, None)], "z double, t double, f double")
    rows = df.select(tail_p("normal", F.col("z")), tail_p("t", F.col("t"), F.lit(10)), tail_p("f", F.col("f"), F.lit(1), F.lit(10))).collect()
    assert list(rows[0]) == pytest.approx([0.05, 0.05, 0.05], rel=1e-9) and list(rows[1]) == [1.0, 1.0, 1.0] and list(rows[2]) == [None] * 3


def test_factors_center_on_one_and_follow_a_scaled_library(spark):
    rnd = random.Random(4)
    base = [rnd.randint(20, 2000) for _ in range(200)]
    rows = [(f"g{j}", s, int(v * k * rnd.uniform(0.97, 1.03)) * (20 if s == "d" and j < 10 else 1)) for j, v in enumerate(base) for s, k in (("a", 1), ("b", 2), ("c", 1), ("d", 1))]
    counts = spark.createDataFrame(rows, "gene string, sample string, count long")
    factors = {r["sample"]: r["norm_factor"] for r in B.tmm_factors(counts).collect()}
    assert math.prod(factors.values()) == pytest.approx(1.0)
    assert factors["a"] == pytest.approx(factors["b"], rel=0.02) and factors["d"] < 0.8 * factors["a"]


def test_module_score_uses_own_bin_and_is_repeatable(spark):
    rnd = random.Random(6)
    cells = spark.createDataFrame([(f"c{i}", "A" if i % 2 else "B") for i in range(12)], "cell string, condition string")
    counts = spark.createDataFrame([(f"g{j}", f"c{i}", rnd.randint(0, j + 1)) for j in range(60) for i in range(12)], "gene string, cell string, count long").filter("count > 0")
    features = spark.createDataFrame([(f"g{j}",) for j in range(60)], "gene string")
    normalized = M.log_normalize(counts)
    bins = {r["gene"]: r["bin"] for r in E_bins(normalized, features).collect()}
    assert sorted(np.bincount(list(bins.values()))[1:].tolist()) == [8, 8, 8, 9, 9, 9, 9] and len(bins) == 60
    chosen = spark.createDataFrame([(S.HIGH_A, "g5"), (S.HIGH_A, "g40"), (S.HIGH_B, "g20")], "signature string, gene string")
    controls = S.control_genes(E_bins(normalized, features), chosen, 5, 1).collect()
    for r in controls:
        mine = {bins[c["gene"]] for c in chosen.collect() if c["signature"] == r["signature"]}
        assert bins[r["gene"]] in mine
    assert sum(r["signature"] == S.HIGH_B for r in controls) == 5
    first = {r["cell"]: r["resistance_score"] for r in S.module_score(normalized, cells, features, chosen, 5, 7, 1).collect()}
    again = {r["cell"]: r["resistance_score"] for r in S.module_score(normalized.repartition(5), cells, features, chosen, 5, 7, 1).collect()}
    assert first == pytest.approx(again) and len(first) == 12


def E_bins(normalized, features):
    return S.expression_bins(normalized, features, 12, 7)


@pytest.mark.parametrize("block_rows", [8, 64, 4096])
def test_neighbours_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    centers = rng.normal(size=(6, 12))
    data = np.vstack([centers[i % 6] + 0.15 * rng.normal(size=12) for i in range(150)] + [centers[0]] * 75 + [np.zeros(12)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "cell long, vector array<double>")
    norm = np.linalg.norm(data, axis=1, keepdims=True)
    unit = np.divide(data, norm, out=np.zeros_like(data), where=norm > 0)
    sims = np.round(unit @ unit.T, 10)
    got = {}
    for r in E.knn_cosine(df, 5, block_rows=block_rows).collect():
        got.setdefault(r["cell"], {})[r["rank"]] = (r["similarity"], r["neighbor"])
    for i in range(len(data)):
        others = sorted((-(sims[i, j] + 0.0), j) for j in range(len(data)) if j != i)[:5]
        mine = [got[i][k] for k in range(1, 6)]
        assert [m[0] for m in mine] == pytest.approx([-o[0] for o in others], abs=1e-9)
        if i < 225:
            assert [m[1] for m in mine] == [o[1] for o in others]


def poisson_dataset(spark, label, shift):
    rng = np.random.default_rng(11 + shift)
    counts = rng.poisson(4, size=(40, 6))
    counts[:8] += shift
    rows = [(f"GENE{j}", f"{label}{i + 1}", int(counts[j, i])) for j in range(40) for i in range(6)]
    features = spark.createDataFrame([(f"GENE{j}",) for j in range(40)], "gene string")
    return CellDataset.from_counts(spark.createDataFrame(rows, "gene string, cell string, count long"), features)


def test_joint_embedding(spark, tmp_path):
    data = {"pbmc": poisson_dataset(spark, "P", 0), "line": poisson_dataset(spark, "K", 8)}
    groups = {"pbmc": "PBMC", "line": "LINE-r"}
    (tmp_path / "c.tsv").write_text("sample\texpected_BCR_ABL1_candidate\n" + "".join(f"K{i}\t{int(i in (1, 3))}\n" for i in range(1, 7)))
    candidates = tables.read_candidates(spark, str(tmp_path / "c.tsv"))
    result = joint_embedding.run(data, groups, candidates, "LINE-r", 30, 20, 5, 4, 3)
    joint, own = result.joint.collect(), result.group.collect()
    assert len(joint) == 12 and len(own) == 6 and sum(r["fusion_candidate"] for r in joint) == 2
    again = {r["cell"]: r["PC_1"] for r in joint_embedding.run(data, groups, candidates, "LINE-r", 30, 20, 5, 4, 3).joint.collect()}
    assert [abs(again[r["cell"]]) for r in joint] == pytest.approx([abs(r["PC_1"]) for r in joint])
    first = {r["cell"]: r["PC_1"] for r in joint}
    split = [first[f"pbmc_P{i}"] for i in range(1, 7)], [first[f"line_K{i}"] for i in range(1, 7)]
    assert max(split[0]) < min(split[1]) or max(split[1]) < min(split[0])
    assert result.joint_graph.groupBy("cell").count().filter("count <> 11").count() == 0
    with pytest.raises(ContractError, match="K6"):
        joint_embedding.run(data, groups, candidates.filter("sample <> 'K6'"), "LINE-r", 30, 20, 5, 4, 3)
    for body in ("sample\texpected_BCR_ABL1_candidate\nK1\t\n", "sample\texpected_BCR_ABL1_candidate\nK1\t2\n", "sample\tx\nK1\t1\n"):
        (tmp_path / "c.tsv").write_text(body)
        with pytest.raises(ContractError):
            tables.read_candidates(spark, str(tmp_path / "c.tsv"))
    (tmp_path / "c.tsv").write_text("sample\texpected_BCR_ABL1_candidate_call\nK1\tcandidate_low_umi\nK2\tnot_detected\n")
    assert sorted(r["candidate"] for r in tables.read_candidates(spark, str(tmp_path / "c.tsv")).collect()) == [0, 1]


def test_components_match_a_dense_decomposition(spark):
    data = poisson_dataset(spark, "c", 3)
    top = E.variable_features(data, 20)
    scaled = E.scale_genes(M.log_normalize(data.counts), top.select("gene", "rank"), 6)
    pcs = {r["cell"]: r["pcs"] for r in E.principal_components(scaled, data.cells, 20, 3).collect()}
    dense = np.zeros((6, 20))
    names = sorted(pcs)
    for r in data.features.join(top.select("gene", "rank"), "gene").collect():
        rows = scaled.filter(F.col("gene") == r["gene"]).collect()
        dense[:, r["rank"] - 1] = rows[0]["z0"]
        for s in rows:
            dense[names.index(s["cell"]), r["rank"] - 1] = s["z"]
    centered = dense - dense.mean(axis=0)
    u, d, _ = np.linalg.svd(centered, full_matrices=False)
    mine = np.array([pcs[n] for n in names])
    mine = mine - mine.mean(axis=0)
    for k in range(3):
        assert abs(np.corrcoef(mine[:, k], (u * d)[:, k])[0, 1]) == pytest.approx(1.0, abs=1e-6)


def test_variable_features_pick_the_overdispersed(spark):
    rng = np.random.default_rng(5)
    means = rng.uniform(1, 30, size=200)
    counts = rng.poisson(means[:, None], size=(200, 60))
    for j in range(10):
        counts[j] = rng.poisson(means[j] * rng.gamma(0.5, 2.0, size=60))
    rows = [(f"g{j}", f"c{i}", int(counts[j, i])) for j in range(200) for i in range(60)]
    data = CellDataset.from_counts(spark.createDataFrame(rows, "gene string, cell string, count long"))
    top = {r["gene"] for r in E.variable_features(data, 12).collect()}
    assert len(top & {f"g{j}" for j in range(10)}) >= 9


def test_10x_folder_and_dataset_manifest(spark, tmp_path):
    import gzip

    for name, body in {
        "matrix.mtx": "%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 3\n2 2 4\n3 1 9\n",
        "features.tsv": "id1\tA\tGene Expression\nid2\tA\tGene Expression\nid3\tAb\tAntibody Capture\n",
        "barcodes.tsv": "c1\nc2\n",
    }.items():
        with gzip.open(tmp_path / f"{name}.gz", "wt") as handle:
            handle.write(body)
    poisson_dataset(spark, "P", 0).write(str(tmp_path / "stored"))
    head = "dataset\tpath\tformat\tgroup\tassay\tfeature_column\n"
    (tmp_path / "m.tsv").write_text(head + f"d1\t{tmp_path}\t10x_dir\tx\tRNA\t.\nd2\t{tmp_path}/stored\tparquet\ty\tRNA\t.\n")
    data, groups = joint_embedding.load_datasets(spark, tables.read_dataset_manifest(spark, str(tmp_path / "m.tsv")))
    assert sorted((r["gene"], r["cell"], r["count"]) for r in data["d1"].counts.collect()) == [("A", "c1", 3), ("A", "c2", 4)]
    assert groups == {"d1": "x", "d2": "y"} and data["d2"].features.count() == 40
    (tmp_path / "m.tsv").write_text(head + "d1\tp\tparquet\tx\tRNA\t.\n")
    with pytest.raises(ContractError):
        tables.read_dataset_manifest(spark, str(tmp_path / "m.tsv"))
