"""Sources and sinks: driver tables written in a file format to the checkpoint folder, read back, and compared with SQL
on the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.functions.reads import fastq_record
from seqlattice.operators.counts import CellDataset
from seqlattice.operators.reads import primary_transcripts
from seqlattice.schemas import Contrast, DeColumns, GeneColumns
from seqlattice.session import checkpoint_folder
from seqlattice.sources import tables, text, writers
from workload.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


# Lines that one part file is meant to hold.
PART_LINES = 500_000


def _put(lines: DataFrame, path: str, *order: str) -> str:
    """Lines as text in several part files, the more the more lines there are, so that a task sorts a bounded number of them."""
    parts = max(5, -(-lines.count() // PART_LINES))
    lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value").write.text(path)
    return path


@query(
    "lines_roundtrip",
    """
    SELECT p AS part, count(*) AS lines, CAST(min(n) AS BIGINT) AS first_line, CAST(max(n) AS BIGINT) AS last_line, count(DISTINCT n) AS numbers, CAST(sum(n * (l_orderkey % 1000)) AS BIGINT) AS weight
    FROM (SELECT *, l_linenumber AS p, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey) AS n FROM lineitem) GROUP BY 1
    """,
)
def lines_roundtrip(spark, folder):
    """One folder for each line number of an order, each with its lines in order in any number of files; their numbers through the folder come back."""
    place = _folder(spark)
    line = F.concat_ws("\t", "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")
    rows = table(spark, folder, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", line.alias("value"))
    order = ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select(F.col("l_linenumber").alias("part"), "value").write.partitionBy("part").text(place)
    lines = text.read_parts(spark, f"{place}/*/*").withColumn("f", F.split("value", "\t"))
    key, number = F.col("f")[1].cast("long"), F.col("line_no")
    return lines.groupBy(F.col("f")[0].cast("long").alias("part")).agg(
        F.count(F.lit(1)).alias("lines"), F.min(number).alias("first_line"), F.max(number).alias("last_line"),
        F.count_distinct(number).alias("numbers"), F.sum(number * (key % 1000)).alias("weight"),
    )


@query(
    "junctions_roundtrip",
    """
    SELECT CASE WHEN l_returnflag = 'A' THEN 'chr22' ELSE 'chr9' END AS chrom1, count(*) AS records, count(*) FILTER (l_quantity > 45) AS malformed,
      CAST(sum(CASE WHEN l_quantity > 45 THEN 0 ELSE l_partkey END) AS BIGINT) AS positions
    FROM lineitem GROUP BY 1
    """,
)
def junctions_roundtrip(spark, folder):
    """Junction files with comments and empty lines between the records, some of them without a position."""
    chrom = F.when(F.col("l_returnflag") == "A", "chr22").otherwise("chr9")
    pos = F.when(F.col("l_quantity") > 45, "none").otherwise(F.col("l_partkey").cast("string"))
    fields = [chrom, pos, F.lit("+"), F.lit("chr1"), F.col("l_suppkey").cast("string"), F.lit("-"), *[F.lit("0")] * 3, F.lit("read"), *[F.lit("1")] * 4]
    record = F.concat_ws("\t", *fields)
    value = F.explode(F.array(record, F.when(F.col("l_linenumber") == 1, F.lit("# comment")).otherwise(F.lit(""))))
    place = _put(table(spark, folder, "lineitem").select("l_orderkey", value.alias("value")), _folder(spark), "l_orderkey")
    found = text.read_junctions(spark, place, sample="s")
    good = ~F.col("malformed")
    return found.groupBy("chrom1").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("malformed").alias("malformed"),
        F.coalesce(F.sum(F.when(good, F.col("pos1")).otherwise(0)), F.lit(0)).alias("positions"),
    )


@query(
    "mtx_roundtrip",
    """
    SELECT p_brand AS gene_id, l_suppkey % 7 AS cell, CAST(sum(l_quantity) AS BIGINT) AS x
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING sum(l_quantity) > 0
    """,
)
def mtx_roundtrip(spark, folder):
    """A sparse matrix through its three files, in parts."""
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cell = (F.col("l_suppkey") % 7).cast("string")
    counts = rows.groupBy(F.col("p_brand").alias("gene"), cell.alias("cell")).agg(F.sum("l_quantity").cast("long").alias("count"))
    place = _folder(spark)
    writers.write_mtx(CellDataset.from_counts(counts), place)
    entries, genes, cells = tables.read_mtx(spark, f"{place}/matrix.mtx", f"{place}/features.tsv", f"{place}/barcodes.tsv")
    named = entries.join(genes.select(F.col("ordinal").alias("i"), "gene_id"), "i").join(cells.select(F.col("ordinal").alias("j"), "cell"), "j")
    return named.select("gene_id", F.col("cell").cast("long").alias("cell"), "x")


@query(
    "umi_counts_roundtrip",
    """
    SELECT 'p' || l_partkey AS gene, 'cell_' || (l_suppkey % 5) AS cell, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2
    """,
)
def umi_counts_roundtrip(spark, folder):
    """A count table per cell, named after it; a cell in a file that is not its own would be refused."""
    cell = F.concat(F.lit("cell_"), F.col("l_suppkey") % 5)
    counts = table(spark, folder, "lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("gene"), cell.alias("cell")).agg(F.sum("l_quantity").cast("long").alias("count"))
    place = _folder(spark)
    for k in range(5):
        writers.write_tsv(counts.filter(F.col("cell") == f"cell_{k}"), f"{place}/cell_{k}", ["gene", "cell", "count"], order=["gene"])
    found = [tables.read_umi_counts(spark, f"{place}/cell_{k}", suffix=r"/part-[^/]*") for k in range(5)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@query(
    "barcode_roundtrip",
    "SELECT 'B' || c_custkey AS barcode FROM customer",
)
def barcode_roundtrip(spark, folder):
    names = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("B"), "c_custkey", F.lit("\tmore")).alias("value"))
    head = spark.sql("SELECT CAST(-1 AS BIGINT) AS c_custkey, 'barcode' AS value")
    place = _put(head.unionByName(names.withColumn("c_custkey", F.col("c_custkey").cast("long"))), _folder(spark), "c_custkey")
    return text.read_barcodes(spark, place, regex="^B[0-9]+$")


@query(
    "gtf_roundtrip",
    """
    SELECT 'g' || p_partkey AS gene_id, p_name AS gene_name, CAST(p_size AS BIGINT) AS "start", CAST(p_size + 10 AS BIGINT) AS "end" FROM part
    """,
)
def gtf_roundtrip(spark, folder):
    part = table(spark, folder, "part")
    attributes = F.format_string('gene_id "g%d"; gene_name "%s";', F.col("p_partkey").cast("long"), "p_name")
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("src"), F.lit("gene"), F.col("p_size").cast("string"), (F.col("p_size") + 10).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    place = _put(part.select("p_partkey", line.alias("value")), _folder(spark), "p_partkey")
    return text.gene_intervals(text.read_gtf(spark, place)).select("gene_id", "gene_name", "start", "end")


@query(
    "fastq_roundtrip",
    """
    SELECT lang, count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, count(DISTINCT doc_id) AS names
    FROM (SELECT doc_id, lang, regexp_replace(text, '[^A-Za-z]', 'N', 'g') AS seq FROM documents) GROUP BY 1
    """,
)
def fastq_roundtrip(spark, folder):
    """Reads of the languages written in folders of compressed files and read back."""
    return _counted(_text_reads(spark, folder), F.length("seq"))


@query(
    "fastq_whole_roundtrip",
    """
    SELECT lang, count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum(length(seq) - length(replace(seq, 'N', ''))) AS BIGINT) AS unknown,
      CAST(max(length(seq)) AS BIGINT) AS longest, count(DISTINCT doc_id) AS names
    FROM (SELECT doc_id, lang, regexp_replace(text, '[^A-Za-z]', 'N', 'g') AS seq FROM documents) GROUP BY 1
    """,
)
def fastq_whole_roundtrip(spark, folder):
    """The reads of ``fastq_roundtrip`` with unknown bases and the longest read."""
    unknown = F.sum(F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit(""))))
    return _counted(_text_reads(spark, folder), F.length("seq"), unknown.alias("unknown"), F.max(F.length("seq")).cast("long").alias("longest"))


@query(
    "fastq_pairs_roundtrip",
    """
    SELECT lang, 'doc' || doc_id AS read_id, length(seq) AS bases, length(seq) - length(replace(seq, 'N', '')) AS unknown,
      translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS barcode
    FROM (SELECT *, regexp_replace(text, '[^A-Za-z]', 'N', 'g') AS seq FROM documents)
    """,
)
def fastq_pairs_roundtrip(spark, folder):
    """Whole texts as first mates and barcodes of them as second ones, in plain files of the same reads; pairs are read by ranges of bytes."""
    from seqlattice.sources.fastq import read_fastq_pairs

    place = _folder(spark)
    seq = F.regexp_replace("text", "[^A-Za-z]", "N")
    code = F.translate(F.md5(F.col("text").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    mates = F.array(F.struct(F.lit("R1").alias("mate"), seq.alias("seq")), F.struct(F.lit("R2").alias("mate"), code.alias("seq")))
    docs = table(spark, folder, "documents").select("lang", "doc_id", F.explode(mates).alias("m"))
    name = F.concat(F.lit("doc"), "doc_id", F.lit("/"), F.substring("m.mate", 2, 1))
    lines = docs.select("lang", "doc_id", F.col("m.mate").alias("mate"), fastq_record(name, "m.seq", "m.seq").alias("value"))
    # A task writes both mates of its reads, so the files of one task belong together.
    dealt = lines.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "mate", "doc_id")
    dealt.select("lang", "mate", "value").write.partitionBy("lang", "mate").text(place)
    files = spark.read.format("binaryFile").load(f"{place}/*/*/*").select("path")
    sample = F.concat_ws(":", F.regexp_extract("path", "lang=([^/]+)", 1), F.regexp_extract("path", "part-([0-9]+)", 1))
    mate = lambda n: F.max(F.when(F.col("path").contains(f"mate=R{n}"), F.col("path"))).alias(f"r{n}")
    manifest = files.groupBy(sample.alias("sample")).agg(mate(1), mate(2))
    pairs = read_fastq_pairs(spark, manifest, split=8 << 20)
    unknown = F.length("seq1") - F.length(F.replace("seq1", F.lit("N"), F.lit("")))
    return pairs.select(F.split("sample", ":")[0].alias("lang"), "read_id", F.length("seq1").alias("bases"), unknown.alias("unknown"), F.col("seq2").alias("barcode"))


@query(
    "primary_roundtrip",
    """
    SELECT 'Q=' || url_encode(p_name || '~' || p_partkey) || '|CB=' || url_encode(translate(p_brand, '#', '*')) || '|UB=' || url_encode(p_type) || '|CR=|UR=' AS star_read_name,
      p_name || '~' || p_partkey AS original_qname, translate(p_brand, '#', '*') AS "CB", p_type AS "UB", '' AS "CR", '' AS "UR",
      CASE WHEN p_size % 2 = 1 THEN reverse(translate(s, 'ACGTRYMKBDHV', 'TGCAYRKMVHDB')) ELSE s END[1:16] AS seq,
      CASE WHEN p_size % 2 = 1 THEN s ELSE reverse(s) END[1:16] AS qual
    FROM (SELECT *, upper(translate(p_name || p_type || p_brand, ' #', 'NN')) AS s FROM part) WHERE p_size <= 45
    """,
)
def primary_roundtrip(spark, folder):
    """Primary alignments as reads and their metadata table, written from the same rows; reads meet their metadata again by name."""
    from seqlattice.sources.fastq import read_fastq_text
    from workload.reads import _sam_lines

    reads = primary_transcripts(text.parse_sam(_sam_lines(spark, folder)), length=16)
    place = _folder(spark)
    writers.write_primary(reads, f"{place}/reads", f"{place}/metadata")
    metadata = tables.read_read_metadata(spark, f"{place}/metadata")
    found = read_fastq_text(spark, f"{place}/reads").select(F.col("read_id").alias("star_read_name"), "seq", "qual")
    return found.join(metadata, "star_read_name").select("star_read_name", "original_qname", "CB", "UB", "CR", "UR", "seq", "qual")


LIBRARIES = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query(
    "wide_roundtrip",
    """
    SELECT CAST(gene AS BIGINT) AS gene, sample, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS count
    FROM (SELECT DISTINCT l_partkey AS gene FROM lineitem) CROSS JOIN (SELECT unnest(['AF', 'AO', 'NF', 'NO', 'RF', 'RO']) AS sample)
    LEFT JOIN lineitem ON l_partkey = gene AND l_returnflag || l_linestatus = sample GROUP BY 1, 2
    """,
)
def wide_roundtrip(spark, folder):
    """A wide count matrix of all libraries, written compressed and read back as counts."""
    sample = F.concat("l_returnflag", "l_linestatus")
    counts = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("gene"), sample.alias("cell"), F.col("l_quantity").cast("long").alias("count"))
    place = _folder(spark)
    writers.write_wide_counts(counts, place, LIBRARIES)
    found, _ = tables.read_bulk_matrix(spark, place, LIBRARIES, GeneColumns("gene_id", "gene_id", "gene_id"))
    return found.select(F.col("gene").cast("long").alias("gene"), "sample", "count")


@query(
    "de_roundtrip",
    """
    SELECT 'g' || p_partkey AS gene_id, p_name AS gene_name, p_brand AS gene_biotype, -2.0::DOUBLE * (((p_partkey * 104729) % 2001 - 1000) / 250.0::DOUBLE) AS "logFC",
      ((p_partkey * 7919) % 10007) / 10007.0::DOUBLE AS "PValue", ((p_partkey * 31) % 101) / 101.0::DOUBLE AS "FDR"
    FROM part
    """,
)
def de_roundtrip(spark, folder):
    """A table of expression changes under other column names; effects are turned round and doubled when it is read."""
    key = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        F.concat(F.lit("g"), key).alias("EnsemblID"), F.col("p_name").alias("gene_name"), F.col("p_brand").alias("kind"),
        (((key * 104729) % 2001 - 1000) / 250.0).alias("change"), (((key * 7919) % 10007) / 10007.0).alias("p"), (((key * 31) % 101) / 101.0).alias("q"),
    )
    place = _folder(spark)
    writers.write_tsv(rows, place, rows.columns, order=["EnsemblID"])
    return tables.read_de_table(spark, place, DeColumns("EnsemblID", "gene_name", "kind", "change", "p", "q"), multiplier=-2.0).drop("ordinal")


@query(
    "sample_tables_roundtrip",
    """
    SELECT 'C' || c_custkey AS sample, row_number() OVER (ORDER BY c_custkey) AS ordinal, CASE c_custkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS condition,
      CAST(c_custkey % 3 = 0 AS INT) AS candidate, c_mktsegment AS "group", 'C' || c_custkey || '_2.fq' AS mate
    FROM customer
    """,
)
def sample_tables_roundtrip(spark, folder):
    """Manifest, conditions, candidates and cell metadata of the same samples, each through its own file, brought together again."""
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        key.alias("key"), F.concat(F.lit("C"), key).alias("sample"), F.when(key % 2 == 0, "A").otherwise("B").alias("condition"),
        (key % 3 == 0).cast("int").alias("expected_BCR_ABL1_candidate"), F.col("c_mktsegment").alias("group"),
    )
    rows = rows.withColumn("r1", F.concat("sample", F.lit("_1.fq"))).withColumn("r2", F.concat("sample", F.lit("_2.fq")))
    place = _folder(spark)
    for name, columns in (("manifest", ["sample", "r1", "r2"]), ("conditions", ["sample", "condition"]), ("candidates", ["sample", "expected_BCR_ABL1_candidate"]), ("cells", ["sample", "group"])):
        writers.write_tsv(rows, f"{place}/{name}", columns, order=["key"])
    manifest = tables.read_manifest(spark, f"{place}/manifest").select("sample", "ordinal", F.regexp_extract("r2", "([^/]+)$", 1).alias("mate"))
    conditions = tables.read_bulk_samples(spark, f"{place}/conditions", Contrast("A", "B")).drop("ordinal")
    candidates, cells = tables.read_candidates(spark, f"{place}/candidates"), tables.read_cell_metadata(spark, f"{place}/cells")
    return manifest.join(conditions, "sample").join(candidates, "sample").join(cells, "sample").select("sample", "ordinal", "condition", "candidate", "group", "mate")


def _text_reads(spark, folder) -> DataFrame:
    """Whole texts as reads, line ends as N like all that is no letter, through FASTQ files in a folder for each language."""
    from seqlattice.sources.fastq import read_fastq_text

    seq = F.regexp_replace("text", "[^A-Za-z]", "N")
    docs = table(spark, folder, "documents").select("lang", F.col("doc_id").alias("ordinal"), F.concat(F.lit("doc"), "doc_id").alias("name"), seq.alias("seq"), seq.alias("qual"))
    place = _folder(spark)
    writers.write_fastq(docs, place, by=["lang"], order=["ordinal"])
    return read_fastq_text(spark, f"{place}/*/*")


def _counted(reads: DataFrame, bases: Column, *more: Column) -> DataFrame:
    lang = F.regexp_extract("file", "lang=([^/]+)", 1)
    return reads.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("reads"), F.sum(bases).alias("bases"), *more, F.count_distinct("read_id").alias("names"))
