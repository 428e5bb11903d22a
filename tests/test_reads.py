import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqlattice.contracts import ContractError
from seqlattice.functions import reads as R
from seqlattice.operators import reads as O
from seqlattice.plans.expression import extract_umis
from seqlattice.sources import fastq, tables, text, writers

ANCHOR = "TTGCGCAATG"


def put_fastq(path, records, compress=True):
    body = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)
    if compress:
        with gzip.open(path, "wt") as handle:
            handle.write(body)
    else:
        path.write_text(body)
    return str(path)


def edge_records():
    first = [
        ("edge1", "TTGCGCAATGACGTACGTGATTACA"),
        ("edge2", "TTGCGCAATGACGT"),
        ("edge3", "TTGCGCAATGACGTACGT"),
        ("edge4", "GGGGGGGGGGGG"),
    ]
    return [(n, s, "I" * len(s)) for n, s in first], [(n, "TGCATGCA", "IIIIIIII") for n, _ in first]


@pytest.fixture()
def edge_manifest(spark, tmp_path):
    one, two = edge_records()
    r1, r2 = put_fastq(tmp_path / "r1.fastq.gz", one), put_fastq(tmp_path / "r2.fastq.gz", two)
    (tmp_path / "m.tsv").write_text(f"sample\tr1\tr2\ncell\t{r1}\t{r2}\n\t\t\n")
    return tables.read_manifest(spark, str(tmp_path / "m.tsv"))


def test_umi_edge_cases(spark, edge_manifest, as_rows):
    split = extract_umis(spark, edge_manifest)
    got = as_rows(split.select("read_id", "umi", "seq1", "umi_class", "name"), "ordinal")
    assert got == [
        ("edge1", "ACGTACGT", "GATTACA", "umi", "edge1|CB:cell|UB:ACGTACGT"),
        ("edge2", "ACGT", "", "umi", "edge2|CB:cell|UB:ACGT"),
        ("edge3", "ACGTACGT", "", "umi", "edge3|CB:cell|UB:ACGTACGT"),
        ("edge4", "", "GGGGGGGGGGGG", "non_umi", "edge4|CB:cell|UB:"),
    ]
    assert O.umi_stats(split).first()[:4] == (4, 3, 3, 1)
    assert O.umi_only(split).count() == 3


def test_anchor_at_read_end_is_non_umi_and_trimmed(spark):
    pairs = spark.createDataFrame([("s", 1, "r", ANCHOR, "I" * 10, "A", "I")], "sample string, ordinal long, read_id string, seq1 string, qual1 string, seq2 string, qual2 string")
    row = O.split_umi(pairs).first()
    assert (row["umi"], row["seq1"], row["qual1"], row["umi_class"], row["anchor_hit"]) == ("", "", "", "non_umi", True)


def test_suffixes_and_mates(spark, tmp_path):
    one = put_fastq(tmp_path / "a.fq.gz", [("pair001/1 x", "A" + ANCHOR + "ACGTACGTGG", "I" * 21)])
    two = put_fastq(tmp_path / "b.fq", [("pair001/2", "TT", "II")], compress=False)
    manifest = spark.createDataFrame([("s", one, two)], "sample string, r1 string, r2 string")
    row = extract_umis(spark, manifest).first()
    assert (row["read_id"], row["umi"], row["seq1"]) == ("pair001", "ACGTACGT", "GG")


@pytest.mark.parametrize(
    "one, two",
    [
        ([("a", "ACGT", "III")], [("a", "A", "I")]),
        ([("a", "A", "I")], [("b", "A", "I")]),
        ([("a", "A", "I"), ("b", "A", "I")], [("a", "A", "I")]),
    ],
)
def test_bad_pairs_are_rejected(spark, tmp_path, one, two):
    r1, r2 = put_fastq(tmp_path / "a.fq.gz", one), put_fastq(tmp_path / "b.fq.gz", two)
    manifest = spark.createDataFrame([("s", r1, r2)], "sample string, r1 string, r2 string")
    with pytest.raises(PySparkException):
        fastq.read_fastq_pairs(spark, manifest).count()


def test_text_path_equals_data_source(spark, tmp_path, as_rows):
    records = [(f"r{i} c", "ACGT" * (i % 5 + 1), "I@+#" * (i % 5 + 1)) for i in range(500)]
    path = put_fastq(tmp_path / "big.fastq", records, compress=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        by_text = as_rows(fastq.read_fastq_text(spark, [path]).select("ordinal", "read_id", "seq", "qual"), "ordinal")
        counted = fastq.count_fastq_records(spark, [path]).first()["records"]
        splits = spark.read.text(path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_source = as_rows(fastq.read_fastq(spark, [path]).select("ordinal", "read_id", "seq", "qual"), "ordinal")
    assert splits > 3 and counted == 500
    assert by_text == by_source == [(i + 1, *r) for i, r in enumerate(records)]


def test_line_count_must_be_fours(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a\nA\n+\n")
    with pytest.raises(ContractError):
        fastq.count_fastq_records(spark, [str(tmp_path / "x.fastq")])


def test_pair_join_reports_faults(spark, as_rows):
    schema = "sample string, ordinal long, read_id string, seq string, qual string"
    one = spark.createDataFrame([("s", 1, "a/1", "A", "I"), ("s", 2, "b/1", "A", "I"), ("s", 3, "c", "A", "I")], schema)
    two = spark.createDataFrame([("s", 1, "a/2", "C", "I"), ("s", 2, "x/2", "C", "I"), ("s", 4, "d", "C", "I")], schema)
    got = as_rows(O.pair_mates(one, two, check=False).select("ordinal", "mate_status"), "ordinal")
    assert got == [(1, "paired"), (2, "id_mismatch"), (3, "missing_r2"), (4, "missing_r1")]
    with pytest.raises(ContractError):
        O.pair_mates(one, two)
    assert O.pair_mates(one.limit(1), two.limit(1)).count() == 1


def test_bottom_k_matches_a_plain_sort(spark, as_rows):
    ids = [f"read{i}" for i in range(300)]
    df = spark.createDataFrame([(i + 1, n) for i, n in enumerate(ids)], "ordinal long, read_id string").repartition(5)
    score = {n: hashlib.blake2b(f"9\0{n}".encode(), digest_size=16).digest() for n in ids}
    best = sorted(range(300), key=lambda i: (score[ids[i]], i))[:40]
    wanted = [(i + 1, k) for k, i in enumerate(sorted(best), start=1)]
    got = as_rows(O.bottom_k(df, "read_id", 40, 9).select("ordinal", "output_index"), "ordinal")
    assert got == wanted
    with pytest.raises(ContractError):
        O.bottom_k(df, "read_id", 301, 9)


def test_subset_files(spark, tmp_path, edge_manifest):
    pairs = fastq.read_fastq_pairs(spark, edge_manifest)
    chosen = O.bottom_k(pairs, "read_id", 3, 5)
    values = {r["metric"]: r["value"] for r in O.subset_summary(pairs, chosen, "cell", 5).collect()}
    assert values["source_total_read_pairs"] == "4" and values["selected_read_pairs"] == "3"
    assert values["source_total_complete_tso_umi_pairs"] == "2"
    writers.write_subset(chosen, "cell", str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "mate=R1")).collect()]
    assert [v for v in lines if v.startswith("@")] == [f"@cell_read_{i:06d}/1" for i in (1, 2, 3)]


def test_split_fastq_round_trip(spark, tmp_path, edge_manifest):
    writers.write_split_fastq(extract_umis(spark, edge_manifest), str(tmp_path / "out"))
    folder = tmp_path / "out" / "sample=cell" / "umi_class=umi" / "mate=R1"
    files = sorted(str(p) for p in folder.glob("*.gz"))
    names = [r["read_id"] for r in fastq.read_fastq(spark, files).orderBy("file", "ordinal").collect()]
    assert names == ["edge1|CB:cell|UB:ACGTACGT", "edge2|CB:cell|UB:ACGT", "edge3|CB:cell|UB:ACGTACGT"]


def sam_line(name, flag, seq, tags, qual=None):
    return "\t".join([name, str(flag), "chr1", "1", "255", f"{len(seq)}M", "*", "0", "0", seq, qual or "I" * len(seq), *tags])


def test_primary_transcripts(spark, tmp_path, as_rows):
    lines = [
        "@HD\tVN:1.6",
        "",
        sam_line("read 1~*", 0, "C" * 100, ["CB:Z:CELL1", "UB:Z:U1", "XX:Z:a:b", "CB:Z:CELL2"]),
        sam_line("read2", 16, "A" * 96, ["CB:Z:CELL1", "UB:Z:U2", "CR:Z:x"], "J" + "I" * 95),
        sam_line("secondary", 256, "A" * 96, []),
    ]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    reads = O.primary_transcripts(text.read_sam(spark, str(tmp_path / "x.sam")))
    got = as_rows(reads.select("star_read_name", "original_qname", "CB", "UB", "CR", "UR", "seq", "qual"), "ordinal")
    assert got[0][:6] == ("Q=read%201~%2A|CB=CELL2|UB=U1|CR=|UR=", "read 1~*", "CELL2", "U1", "", "")
    assert got[0][6] == "C" * 96 and len(got) == 2
    assert got[1][6] == "T" * 96 and got[1][7] == "I" * 95 + "J"
    writers.write_primary(reads, str(tmp_path / "fq"), str(tmp_path / "meta"))
    meta = tables.read_read_metadata(spark, str(tmp_path / "meta"))
    assert meta.count() == 2 and meta.filter("UR = ''").count() == 2
    with pytest.raises(ContractError):
        O.primary_transcripts(text.read_sam(spark, str(tmp_path / "x.sam")), length=97)
    with pytest.raises(ContractError):
        writers.write_primary(reads.filter("false"), str(tmp_path / "fq2"), str(tmp_path / "meta2"))


def test_manifest_contracts(spark, tmp_path):
    def load(body):
        path = tmp_path / "m.tsv"
        path.write_text(body)
        return tables.read_manifest(spark, str(path)).count()

    assert load("sample\tr1\tr2\na\tx\ty\nb\tx\tz\n") == 2
    for body in (
        "sample\tr1\na\tx\n",
        "sample\tr1\tr2\n",
        "sample\tr1\tr2\na\tx\ty\na\tx\tz\n",
        "sample\tr1\tr2\n-a\tx\ty\n",
        "sample\tr1\tr2\n\tx\ty\n",
        "sample\tr1\tr2\na\tx\tx\n",
    ):
        with pytest.raises(ContractError):
            load(body)


def test_manifest_files_are_found_next_to_it(spark, tmp_path):
    one, two = edge_records()
    put_fastq(tmp_path / "r1.fastq.gz", one), put_fastq(tmp_path / "r2.fastq.gz", two)
    (tmp_path / "m.tsv").write_text("sample\tr1\tr2\ncell\tr1.fastq.gz\tr2.fastq.gz\n")
    manifest = tables.read_manifest(spark, str(tmp_path / "m.tsv"), check_files=True)
    assert extract_umis(spark, manifest).count() == 4
    (tmp_path / "m.tsv").write_text("sample\tr1\tr2\ncell\tr1.fastq.gz\tother.gz\n")
    with pytest.raises(ContractError):
        tables.read_manifest(spark, str(tmp_path / "m.tsv"), check_files=True)


def test_tags(spark):
    df = spark.createDataFrame([("r|CB:c|UB:u",), ("r|CB:c|UB:",)], "name string")
    tagged = df.select(R.extract_tag("name", "CB").alias("CB"), R.extract_tag("name", "UB").alias("UB"))
    assert O.tag_completeness(tagged, mode="any").first()[:] == (2, 1)
    with pytest.raises(ContractError):
        O.tag_completeness(tagged, mode="all")
    with pytest.raises(ContractError):
        O.tag_completeness(tagged.filter("false"), ["CB"], mode="any")


def test_reverse_complement_keeps_ambiguity_codes(spark):
    df = spark.createDataFrame([("ACGTRYKMBDHVNacgt",)], "s string")
    assert df.select(R.reverse_complement("s")).first()[0] == "acgtNBDHVKMRYACGT"
    assert df.select(R.reverse_complement(R.reverse_complement("s"))).first()[0] == "ACGTRYKMBDHVNacgt"
    keep = spark.createDataFrame([(" TRUE ",), ("no",), ("maybe",)], "k string").select(R.parse_keep("k").alias("k"))
    assert [r["k"] for r in keep.collect()] == [True, False, None]
    assert df.select(F.lit(1)).count() == 1
