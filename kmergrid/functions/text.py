"""File-name, header and template helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FASTA, FASTQ, FASTQ_GZ = "fasta", "fastq", "fastq.gz"

# File name endings (no dot required) and the type they stand for.
ENDINGS = (
    (FASTQ_GZ, ("fastq.gz", "fq.gz")),
    (FASTA, ("fa", "fasta", "fna")),
    (FASTQ, ("fastq", "fq")),
)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name up to its last dot."""
    return F.regexp_extract(base_name(path), r"^(.*)\.[^.]*$", 1)


def file_extension(path: Column) -> Column:
    """What follows the last dot; the whole name when there is none."""
    return F.substring_index(base_name(path), ".", -1)


def file_type(path: Column) -> Column:
    """Sequence format by file name ending, NULL when unknown."""
    out = None
    for kind, endings in ENDINGS:
        hit = path.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def type_of(path: str) -> str:
    """:func:`file_type` for one path; raises when the type is unknown."""
    for kind, endings in ENDINGS:
        if path.endswith(endings):
            return kind
    raise ValueError(f"unknown sequence file type: {path}")


def header_token(line: Column) -> Column:
    """First word of a ``>`` header line."""
    return F.split(F.substring(line, 2, F.length(line)), r"\s+")[0]


def fill_template(line: Column, stdout: Column, command: Column) -> Column:
    """Replace the two scheduler placeholders, literally."""
    return F.replace(F.replace(line, F.lit("$STDOUT"), stdout), F.lit("$COMMAND"), command)


def hsl(hue: Column, saturation: Column, lightness: Column) -> Column:
    """Colour as a struct: degrees in [0, 360), the rest clipped to [0, 1]."""
    def unit(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.struct((hue - F.floor(hue / 360.0) * 360.0).alias("h"),
                    unit(saturation).alias("s"), unit(lightness).alias("l"))
