"""Column functions over read names, sequences and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide ambiguity codes and their complements, upper and lower case.
BASES = "ACGTRYMKBDHVNacgtrymkbdhvn"
COMPLEMENTS = "TGCAYRKMVHDBNtgcayrkmvhdbn"

SECONDARY_OR_SUPPLEMENTARY = 0x900
REVERSED = 0x10


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_id(name: Column | str) -> Column:
    """First whitespace-delimited token without a mate suffix."""
    token = F.split(F.trim(_col(name)), r"\s+")[0]
    return F.regexp_replace(token, "/[12]$", "")


def annotate_name(read_id: Column | str, cell: Column | str, umi: Column | str) -> Column:
    return F.concat(_col(read_id), F.lit("|CB:"), _col(cell), F.lit("|UB:"), F.coalesce(_col(umi), F.lit("")))


def extract_tag(name: Column | str, tag: str) -> Column:
    """First ``|TAG:value`` of an annotated read name; empty if absent."""
    return F.regexp_extract(_col(name), rf"(?:^|\|){tag}:([^|]+)", 1)


def anchor_position(sequence: Column | str, anchor: str) -> Column:
    """1-based position of the first anchor; 0 if absent."""
    return F.instr(_col(sequence), anchor)


def umi_after(sequence: Column | str, anchor: str, length: int) -> Column:
    """Up to ``length`` characters after the first anchor; empty without an anchor."""
    at = anchor_position(sequence, anchor)
    return F.when(at > 0, F.substring(_col(sequence), at + len(anchor), F.lit(length))).otherwise(F.lit(""))


def rest_after(text: Column | str, sequence: Column | str, anchor: str, length: int) -> Column:
    """``text`` from behind the anchor and UMI of ``sequence``; unchanged without an anchor."""
    at = anchor_position(sequence, anchor)
    text = _col(text)
    return F.when(at > 0, F.substring(text, at + (len(anchor) + length), F.length(text))).otherwise(text)


def has_complete_umi(sequence: Column | str, anchor: str, length: int) -> Column:
    """The anchor is followed by a full-length UMI."""
    at = anchor_position(sequence, anchor)
    return (at > 0) & (F.length(_col(sequence)) >= at - 1 + len(anchor) + length)


def reverse_complement(sequence: Column | str) -> Column:
    return F.reverse(F.translate(_col(sequence), BASES, COMPLEMENTS))


def is_reversed(flag: Column | str) -> Column:
    return _col(flag).bitwiseAND(REVERSED) != 0


def is_primary(flag: Column | str, mask: int = SECONDARY_OR_SUPPLEMENTARY) -> Column:
    return _col(flag).bitwiseAND(mask) == 0


def percent_encode(value: Column | str) -> Column:
    """Percent-encode everything but letters, digits and ``-._~``."""
    form = F.url_encode(_col(value))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(found), F.lit(wanted))
    return form


def tag_or_empty(tags: Column | str, tag: str) -> Column:
    return F.coalesce(_col(tags)[tag], F.lit(""))


def species(reference: Column | str, prefix: str = "mouse_") -> Column:
    return F.when(_col(reference).startswith(prefix), "mouse").otherwise("human")


def parse_keep(value: Column | str) -> Column:
    """Boolean of a tolerant yes/no text; null for anything else."""
    text = F.lower(F.trim(_col(value).cast("string")))
    return F.when(text.isin("true", "t", "1", "yes"), True).when(text.isin("false", "f", "0", "no"), False)


def output_name(prefix: str, ordinal: Column | str, mate: int) -> Column:
    """De-identified read name, numbered in file order."""
    return F.format_string(f"{prefix}_read_%06d/{mate}", _col(ordinal))


def fastq_record(name: Column | str, sequence: Column | str, quality: Column | str) -> Column:
    return F.concat(F.lit("@"), _col(name), F.lit("\n"), _col(sequence), F.lit("\n+\n"), _col(quality))
