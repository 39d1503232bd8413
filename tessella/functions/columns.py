"""Scalar functions as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_peak(peak: Column) -> Column:
    """`chr1-100-200` -> struct(chrom without chr, start, end); null unless there are three parts and both ends are numbers."""
    parts = F.split(peak, "-")
    start, end = F.try_element_at(parts, F.lit(2)).try_cast("long"), F.try_element_at(parts, F.lit(3)).try_cast("long")
    made = F.struct(F.regexp_replace(parts[0], "^chr", "").alias("chrom"), start.alias("start"), end.alias("end"))
    return F.when((F.size(parts) == 3) & start.isNotNull() & end.isNotNull(), made)


def parse_region(peak: Column) -> Column:
    """`chr1:5-9`, `chr1-5-9` or `chr1_5_9`, `chr` added if missing -> struct(chrom, start, end); null unless start < end."""
    pattern = r"^(.+?)[:\-_](\d+)[\-_](\d+)$"
    name = F.regexp_extract(peak, pattern, 1)
    start, end = (F.regexp_extract(peak, pattern, k).try_cast("long") for k in (2, 3))
    chrom = F.when(name.startswith("chr"), name).otherwise(F.concat(F.lit("chr"), name))
    return F.when(start < end, F.struct(chrom.alias("chrom"), start.alias("start"), end.alias("end")))


def tile_centre(start: Column, end: Column, width: int = 500) -> Column:
    first, last = F.floor(start / width) * width, (F.floor(end / width) + 1) * width
    return F.floor((first + last) / 2).cast("long")


def overlaps(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Closed intervals."""
    return (start1 <= end2) & (end1 >= start2)


def peak_gene_weight(distance: Column, in_body: Column, in_promoter: Column, relative: Column) -> Column:
    """Distance decay plus bonuses for gene body and promoter; what lies downstream counts 0.8."""
    decay = F.exp(F.lit(-0.5) * F.pow(distance / F.lit(50000.0), 2))
    return (decay + F.lit(0.5) * in_body.cast("double") + F.lit(5.0) * in_promoter.cast("double")) * F.when(relative < 0, 1.0).otherwise(0.8)


def sample_of(cell_id: Column) -> Column:
    return F.split_part(cell_id, F.lit(":"), F.lit(1))


def base_unit(unit: Column, modalities=("RNA", "ATAC")) -> Column:
    return F.regexp_replace(unit, f"_({'|'.join(modalities)})$", "")


def modality_of(unit: Column, modalities=("RNA", "ATAC")) -> Column:
    out = F.lit(None).cast("string")
    for m in modalities:
        out = F.when(unit.endswith(f"_{m}"), m).otherwise(out)
    return out


def is_ensembl(gene: Column) -> Column:
    return F.upper(gene).rlike(r"^ENS[A-Z]*G\d+(\.\d+)?$")


def gene_key(gene: Column) -> Column:
    """Ensembl ids lose their version; symbols are upper-cased."""
    return F.when(is_ensembl(gene), F.substring_index(F.upper(gene), ".", 1)).otherwise(F.upper(F.trim(gene)))


def barcode(text: Column) -> Column:
    """The 16-base barcode, else the experiment accession, else null."""
    cell, accession = F.regexp_extract(text, "([ACGT]{16})", 1), F.regexp_extract(text, r"(ENC[SR]\w+)", 1)
    return F.when(cell != "", cell).when(accession != "", accession)


def clean_string(value: Column) -> Column:
    """Null and NaN become Unknown, a whole float loses its `.0`."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")
    return F.when(value.isNull() | F.lower(text).isin("nan", "none", ""), "Unknown").otherwise(text)


def severity(value: Column, ordinals: dict[str, float]) -> Column:
    """A number if it is one, else the ordinal of the trimmed, lower-cased word, else null."""
    word = F.lower(F.trim(value.cast("string")))
    known = F.lit(None).cast("double")
    for k, v in ordinals.items():
        known = F.when(word == k, float(v)).otherwise(known)
    return F.coalesce(value.try_cast("double"), known)


def batch_key(*columns: Column) -> Column:
    return F.concat_ws("__", *[c.cast("string") for c in columns])


def block_weights(k_composition: int, k_medium: int, k_fine: int, alpha: float) -> list[float]:
    """Weights that give each composition block the norm of the finest; every k is 2 at least."""
    c, m, f = (max(2, k) for k in (k_composition, k_medium, k_fine))
    return [(f / c) ** 0.5, (f / m) ** 0.5, 1.0, alpha]


def relabel_feature(name: Column, mapping: dict[str, str], separator: str = " - ") -> Column:
    """`type - gene` with its type mapped; unmapped types stay."""
    kind, rest = F.substring_index(name, separator, 1), F.regexp_replace(name, "^.*?" + separator, "")
    out = kind
    for old, new in mapping.items():
        out = F.when(kind == old, new).otherwise(out)
    return F.when(F.instr(name, separator) > 0, F.concat(out, F.lit(separator), rest)).otherwise(name)
