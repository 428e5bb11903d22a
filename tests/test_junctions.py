import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqlattice.contracts import ContractError
from seqlattice.functions.regions import aligned_blocks
from seqlattice.operators import fusion as X
from seqlattice.operators import ranges as G
from seqlattice.operators import reads as O
from seqlattice.plans import categories, fusion_screen
from seqlattice.schemas import Region
from seqlattice.sources import tables, text

A, B = Region("BCR", "chr22", 100, 250), Region("ABL1", "chr9", 250, 400)


def junction(c1, p1, s1, c2, p2, s2, name, width=14):
    fields = [c1, str(p1), s1, c2, str(p2), s2, "1", "0", "0", name, "1", "10M", "2", "20M", "x"]
    return "\t".join(fields[:width])


def put_samples(folder, samples, done=True):
    for sample, lines in samples.items():
        target = folder / sample
        target.mkdir(parents=True)
        (target / f"{sample}_Chimeric.out.junction").write_text("".join(f"{line}\n" for line in lines))
        if done:
            (target / f"{sample}_fusion_mapping.done").write_text("done\n")


@pytest.fixture()
def edge_folder(tmp_path):
    put_samples(
        tmp_path / "mapped",
        {
            "forward": ["# one", " # two", junction("chr22", 200, "+", "chr9", 300, "+", "read_forward|CB:forward|UB:AAAAAAAA")],
            "reverse": [junction("chr9", 300, "+", "chr22", 200, "+", "read_reverse|CB:reverse|UB:CCCCCCCC", 15)],
            "wrong_strand": [junction("chr22", 200, "-", "chr9", 300, "+", "r|CB:w|UB:GGGGGGGG")],
            "empty": [],
        },
    )
    return tmp_path / "mapped"


def manifest(spark, *samples):
    return spark.createDataFrame([(s, i) for i, s in enumerate(samples)], "sample string, ordinal int")


SUMMARY = "sample mapping_status chimeric_records_total malformed_records expected_orientation_read_records unique_read_names unique_UB unique_junctions expected_BCR_ABL1_candidate expected_BCR_ABL1_candidate_call".split()


def test_edge_case_summary(spark, edge_folder, tmp_path, as_rows):
    names = ("forward", "reverse", "wrong_strand", "empty")
    result = fusion_screen.run(spark, manifest(spark, *names), str(edge_folder), A, B, out=str(tmp_path / "out"))
    assert as_rows(result.summary.select(*SUMMARY), "ordinal") == [
        ("forward", "complete", 1, 0, 1, 1, 1, 1, 1, "candidate_low_umi"),
        ("reverse", "complete", 1, 0, 1, 1, 1, 1, 1, "candidate_low_umi"),
        ("wrong_strand", "complete", 1, 0, 0, 0, 0, 0, 0, "not_detected"),
        ("empty", "complete", 0, 0, 0, 0, 0, 0, 0, "not_detected"),
    ]
    assert result.candidates.columns[15:22] == [
        "cigar1", "start2", "cigar2", "report_order", "bcr_abl_interval_match", "bcr_abl_strand_match", "bcr_abl_expected_orientation",
    ][:7] or len(result.candidates.columns) == 29
    got = {r["sample"]: (r["source_line"], r["report_order"], r["canonical_bcr_pos"]) for r in result.candidates.collect()}
    assert got == {"forward": (3, "BCR_then_ABL1", 200), "reverse": (1, "ABL1_then_BCR", 200)}
    written = spark.read.csv(str(tmp_path / "out" / "project_summary_all_samples"), sep="\t", header=True)
    assert written.columns == SUMMARY and written.count() == 4


def test_missing_unfinished_and_malformed(spark, edge_folder, as_rows):
    put_samples(edge_folder, {"unfinished": [junction("chr22", 200, "+", "chr9", 300, "+", "r")]}, done=False)
    bad = [junction("chr22", 200, "+", "chr9", 300, "+", "r|UB:A"), "short\tline", junction("chr22", "1.5", "+", "chr9", 300, "+", "r")]
    put_samples(edge_folder, {"bad": bad})
    samples = manifest(spark, "forward", "missing_sample", "unfinished", "bad")
    result = fusion_screen.run(spark, samples, str(edge_folder), A, B, fail_on_missing=False, fail_on_malformed=False)
    assert as_rows(result.summary.select(*SUMMARY), "ordinal")[1:] == [
        ("missing_sample", "missing_junction_file", 0, 0, 0, 0, 0, 0, None, "not_evaluated_missing_junction"),
        ("unfinished", "incomplete_mapping", 0, 0, 0, 0, 0, 0, None, "not_evaluated_incomplete_mapping"),
        ("bad", "malformed_junction_records", 3, 2, 1, 1, 1, 1, None, "not_evaluated_malformed_junctions"),
    ]
    assert {r["sample"] for r in result.records.collect()} == {"forward", "bad"}
    for missing, malformed in ((True, False), (False, True)):
        with pytest.raises(ContractError):
            X.enforce_policy(result.summary, missing, malformed)


def test_large_sample_counts(spark, as_rows):
    """Counts in the proportions of the published fixture: 58 and 73 records, 2 and 3 UMIs."""
    lines = []
    umis = {"one": [("GTATCACG", 57), ("GTCTCACG", 1)], "two": [("AAAAAAAA", 36), ("CCCCCCCC", 35), ("GGGGGGGG", 2)]}
    breaks = {"one": 3, "two": 32}
    for sample, parts in umis.items():
        flat = list(itertools.chain.from_iterable([u] * n for u, n in parts))
        for i, umi in enumerate(flat):
            lines.append((sample, i, junction("chr22", 100 + i % breaks[sample], "+", "chr9", 300, "+", f"r{i}|CB:{sample}|UB:{umi}")))
    df = text.parse_junctions(spark.createDataFrame(lines, "sample string, line_no long, value string"))
    summary = X.evidence_summary(df, manifest(spark, "one", "two", "negative"), A, B)
    assert [r[1:] for r in as_rows(summary.select(*SUMMARY), "ordinal")] == [
        ("complete", 58, 0, 58, 58, 2, 3, 1, "candidate_ge_min_umi"),
        ("complete", 73, 0, 73, 73, 3, 32, 1, "candidate_ge_min_umi"),
        ("complete", 0, 0, 0, 0, 0, 0, 0, "not_detected"),
    ]


def test_first_order_wins_when_regions_overlap(spark):
    one, two = Region("BCR", "chr1", 1, 100, "+"), Region("ABL1", "chr1", 50, 200, "-")
    row = spark.createDataFrame([("chr1", 60, "+", "chr1", 70, "-")], "chrom1 string, pos1 long, strand1 string, chrom2 string, pos2 long, strand2 string")
    got = X.classify_pair(row, one, two).first()
    assert (got["report_order"], got["canonical_a_pos"], got["expected_orientation"]) == ("BCR_then_ABL1", 60, 1)


GTF = """# comment
chr22\tx\tgene\t90\t200\t.\t+\t.\tgene_id "E1"; gene_name "BCR"; tag "a"; tag "b";
chr22\tx\texon\t90\t150\t.\t+\t.\tgene_id "E1"; gene_name "BCR_exon"; gene_type "t";
chr9\tx\tgene\t290\t400\t.\t+\t.\tgene_id "E2"; gene_name "ABL1"; gene_biotype "coding"; gene_type "other";
chr1\tx\tgene\t490\t600\t.\t-\t.\tgene_id "E3"; gene_name "GENE1"; gene_type "t3";
chr2\tx\tgene\t690\t800\t.\t+\t.\tgene_id "E4"; gene_name "GENE2";
chr3\tx\texon\t1\t5\t.\t+\t.\tgene_id "E5";
"""


def test_gtf_views(spark, tmp_path, as_rows):
    (tmp_path / "g.gtf").write_text(GTF)
    gtf = text.read_gtf(spark, str(tmp_path / "g.gtf"))
    assert as_rows(text.gene_annotation(gtf), "gene_id") == [
        ("E1", "BCR", "NA"), ("E2", "ABL1", "coding"), ("E3", "GENE1", "t3"), ("E4", "GENE2", "NA"), ("E5", "E5", "NA"),
    ]
    assert text.gene_intervals(gtf).count() == 4 and text.exon_intervals(gtf).count() == 2
    (tmp_path / "bad.gtf").write_text('chr1\tx\tgene\t5\t2\t.\t+\t.\tgene_id "E";\n')
    with pytest.raises(ContractError):
        text.gene_intervals(text.read_gtf(spark, str(tmp_path / "bad.gtf")))
    with pytest.raises(ContractError):
        text.gene_intervals(gtf.filter("feature = 'exon'"))


def chimeric_inputs(spark, tmp_path):
    sam = []
    for name, flag, cell, umi in (("read1", 0, "CELL1", "U1"), ("read2", 16, "CELL1", "U2"), ("read3", 0, "CELL2", "U3"), ("secondary", 256, "CELL2", "U9")):
        sam.append("\t".join([name, str(flag), "chr1", "1", "255", "96M", "*", "0", "0", "A" * 96, "I" * 96, f"CB:Z:{cell}", f"UB:Z:{umi}"]))
    (tmp_path / "x.sam").write_text("\n".join(sam) + "\n")
    metadata = O.primary_transcripts(text.read_sam(spark, str(tmp_path / "x.sam")))
    name = {r["original_qname"]: r["star_read_name"] for r in metadata.collect()}
    lines = [
        "# header",
        junction("chr22", 100, "+", "chr9", 300, "+", name["read1"]),
        junction("chr22", 101, "+", "chr9", 301, "+", name["read1"]),
        junction("chr22", 100, "+", "chr1", 500, "+", name["read2"]),
        junction("chr9", 300, "+", "chr2", 700, "+", name["read3"]),
    ]
    (tmp_path / "c.junction").write_text("\n".join(lines) + "\n")
    (tmp_path / "g.gtf").write_text(GTF)
    (tmp_path / "b.txt").write_text("Barcode\nCELL1\nCELL2\n")
    return (
        text.read_junctions(spark, str(tmp_path / "c.junction"), sample="k"),
        metadata.drop("seq", "qual", "ordinal"),
        text.gene_intervals(text.read_gtf(spark, str(tmp_path / "g.gtf"))),
        text.read_barcodes(spark, str(tmp_path / "b.txt")),
    )


def test_categories(spark, tmp_path, as_rows):
    junctions, metadata, genes, called = chimeric_inputs(spark, tmp_path)
    report = categories.run(junctions, metadata, genes, called)
    got = {r["category"]: r for r in report.summary.collect()}
    assert {c: r["physical_reads_all"] for c, r in got.items()} == {"whole_intergene": 3, "BCR_any": 2, "ABL1_any": 2, "BCR_ABL1": 1}
    both = got["BCR_ABL1"]
    assert (both["fusion_cb_umi_pairs"], both["total_called_cb_umi_pairs"], both["positive_called_cells"], both["total_called_cells"]) == (1, 3, 1, 2)
    assert both["fusion_umi_percent"] == pytest.approx(100 / 3) and both["positive_cell_percent"] == 50
    assert as_rows(report.support.filter("category = 'BCR_ABL1'")) == [("BCR_ABL1", "read1", "CELL1", "U1", 1)]
    report.write(str(tmp_path / "out"))
    listed = spark.read.csv(str(tmp_path / "out" / "annotated_intergenic_junctions"), sep="\t", header=True)
    assert "ABL1_any,BCR_ABL1,BCR_any,whole_intergene" in {r["categories"] for r in listed.collect()}
    with pytest.raises(ContractError):
        categories.run(junctions, metadata.filter("original_qname <> 'read3'"), genes, called)
    with pytest.raises(ContractError):
        categories.run(junctions.withColumn("malformed", F.lit(True)), metadata, genes, called)


def test_last_record_gives_tags_and_empty_denominator(spark, as_rows):
    schema = "source_line long, original_qname string, CB string, UB string, categories array<string>"
    annotated = spark.createDataFrame([(1, "q", "C1", "U1", ["whole_intergene"]), (2, "q", "C2", "", ["whole_intergene"])], schema)
    called = spark.createDataFrame([("C2",)], "barcode string")
    support = X.category_support(annotated, called)
    assert as_rows(support) == [("whole_intergene", "q", "C2", "", 1)]
    metadata = spark.createDataFrame([("C1", "U1"), ("C2", "")], "CB string, UB string")
    row = X.category_summary(support, metadata, called).filter("category = 'whole_intergene'").first()
    assert (row["fusion_cb_umi_pairs"], row["fusion_umi_percent"], row["positive_called_cells"]) == (0, None, 1)


def test_gene_in_two_intervals_counts_once(spark):
    genes = spark.createDataFrame([("c", 1, 10, "g1", "A", "+"), ("c", 5, 20, "g1", "A", "+"), ("c", 100, 110, "g2", "B", "+")], "chrom string, start long, end long, gene_id string, gene_name string, strand string")
    ends = spark.createDataFrame([(1, "c", 7, "c", 105)], "source_line long, chrom1 string, pos1 long, chrom2 string, pos2 long")
    assert X.annotate_pairs(ends, genes).count() == 1


@pytest.mark.parametrize("bin_size", [1, 7, 50, 1000])
@pytest.mark.parametrize("mode", ["broadcast", "swept"])
def test_range_join_equals_nested_loop(spark, bin_size, mode):
    rnd = random.Random(bin_size)
    points = [(i, rnd.choice("xy"), 30 if i % 3 == 0 else rnd.randint(0, 300)) for i in range(200)]
    spans = [(j, rnd.choice("xy"), s, s + rnd.randint(0, 60)) for j, s in enumerate(rnd.randint(0, 300) for _ in range(60))]
    left = spark.createDataFrame(points, "id int, chrom string, pos long")
    right = spark.createDataFrame(spans, "gene int, chrom string, start long, end long")
    options = {"broadcast": {}, "swept": {"broadcast_rows": 0}}[mode]
    got = sorted((r["id"], r["gene"]) for r in G.range_join(left, right, bin_size=bin_size, **options).collect())
    assert got == sorted((p[0], s[0]) for p in points for s in spans if p[1] == s[1] and s[2] <= p[2] <= s[3])
    outer = G.range_join(left, right, bin_size=bin_size, how="left", **options)
    assert outer.select("id").distinct().count() == 200
    wide = left.select("id", "chrom", F.col("pos").alias("from"), (F.col("pos") + 25).alias("to"))
    pairs = sorted((r["id"], r["gene"]) for r in G.overlap_join(wide, right, bin_size=bin_size, **options).collect())
    assert pairs == sorted((p[0], s[0]) for p in points for s in spans if p[1] == s[1] and p[2] <= s[3] and p[2] + 25 >= s[2])


def test_small_annotation_needs_no_shuffle_of_points(spark):
    points = spark.range(1000).select(F.lit("c").alias("chrom"), F.col("id").alias("pos"))
    genes = spark.createDataFrame([("c", 5, 9)], "chrom string, start long, end long")
    plan = G.range_join(points, genes)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan


def test_blocks_and_assignment(spark, as_rows):
    df = spark.createDataFrame([("5S10M2I3D5M100N20M4H",), ("10M",), ("*",)], "cigar string")
    got = [[tuple(b) for b in r[0]] for r in df.select(aligned_blocks(F.lit(101), "cigar")).collect()]
    assert got == [[(101, 118), (219, 238)], [(101, 110)], []]
    exons = spark.createDataFrame([("c", 100, 120, "g1"), ("c", 110, 130, "g2"), ("c", 220, 230, "g1")], "chrom string, start long, end long, gene_id string")
    rows = [
        (1, 3, "c", 100, 255, "5M50N5M", None), (2, 3, "c", 112, 255, "5M", None), (3, 3, "c", 500, 255, "5M", None),
        (4, 3, "c", 100, 255, "5M", 2), (5, 9, "c", 100, 255, "5M", 1), (6, 3, "c", 100, 3, "5M", 1), (7, 3, "c", 101, 255, "3M117N3M", 1),
    ]
    reads = spark.createDataFrame(rows, "id int, flag int, rname string, pos long, mapq int, cigar string, nh int")
    assigned = as_rows(G.assign_reads(reads, exons, ["id"]).select("id", "status", "gene_id"), "id")
    assert assigned == as_rows(G.assign_reads(reads, exons, ["id"], broadcast_rows=0).select("id", "status", "gene_id"), "id")
    assert assigned == [
        (1, "Assigned", "g1"), (2, "Unassigned_Ambiguity", None), (3, "Unassigned_NoFeatures", None),
        (4, "Unassigned_MultiMapping", None), (5, "Unassigned_Singleton", None), (7, "Assigned", "g1"),
    ]


def test_barcodes_and_metadata_contracts(spark, tmp_path):
    path = tmp_path / "b.tsv"
    path.write_text("cell_barcode\nAAA-1\tx\nCCC-1\n")
    assert text.read_barcodes(spark, str(path), r"^[ACGTN]+-[0-9]+$", 2).count() == 2
    for body, options in (("AAA\nAAA\n", {}), ("barcode\n", {}), ("AAA\n", {"regex": "-1$"}), ("AAA\n", {"expect_count": 5})):
        path.write_text(body)
        with pytest.raises(ContractError):
            text.read_barcodes(spark, str(path), **options)
    head = "star_read_name\toriginal_qname\tCB\tUB\tCR\tUR\n"
    meta = tmp_path / "m.tsv"
    meta.write_text(head + "a\tq\tC\tU\t\t\na\tq\tC\tU\t\t\n")
    assert tables.read_read_metadata(spark, str(meta)).count() == 1
    meta.write_text(head + "a\tq\tC\tU\t\t\na\tq\tC\tV\t\t\n")
    with pytest.raises(ContractError):
        tables.read_read_metadata(spark, str(meta))


def test_points_move_without_their_bin(spark):
    from seqlattice.operators.ranges import range_join

    points = spark.createDataFrame([("c", 5), ("c", 19), ("c", 20), ("d", 5), ("c", None)], "chrom string, pos long")
    genes = spark.createDataFrame([("c", 1, 19, "g"), ("c", 20, 40, "h")], "chrom string, start long, end long, gene string")
    for limit in (0, 100):
        joined = range_join(points, genes, bin_size=16, how="left", broadcast_rows=limit)
        node = joined._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "Join":
            node = node.children().head()
        assert "_bin" not in node.left().output().mkString(",")
        found = {(r["chrom"], r["pos"], r["gene"]) for r in joined.collect()}
        assert found == {("c", 5, "g"), ("c", 19, "g"), ("c", 20, "h"), ("d", 5, None), ("c", None, None)}


def test_pairs_are_counted_by_names_only(spark):
    from workload.junctions import QUERIES

    plan = QUERIES["intergenic_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    seen, left = [], [plan]
    while left:
        node = left.pop()
        if node.nodeName() == "Aggregate":
            seen.append(node.groupingExpressions().mkString(","))
        left += [node.children().apply(k) for k in range(node.children().size())]
    assert seen and not [keys for keys in seen if "categories" in keys]
    # The distinct genes are written, so no use of them aggregates them again.
    assert not [keys for keys in seen if "gene_id" in keys]
