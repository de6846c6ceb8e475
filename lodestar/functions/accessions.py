"""Identifiers of archives, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sequence-archive accession is a letter for the archive, R, a letter for what it names, and digits.
NAMED = {"P": "study", "S": "sample", "X": "experiment", "R": "run", "A": "submission"}
RECORD = rf"^[DES]R([{''.join(NAMED)}])\d{{6,}}$"
#: Accessions of the project and the sample registers that the archives share.
REGISTERS = {"study": r"^PRJ[A-Z]{2}\d+$", "sample": r"^SAM(?:N|D|E[AD]?)\d{6,}$"}
#: Beginnings of ids and what they stand for (fixed formats).
PREFIXES = {"project": ("GSE", "PRJNA", "E-"), "series": ("SRP",), "sample": ("GSM", "SRS", "SAMN", "SAME")}


def family_of(c: Column) -> Column:
    """What an accession of the archives names, NULL for other ids."""
    up = F.upper(F.trim(c))
    letter = F.regexp_extract(up, RECORD, 1)
    return F.coalesce(*[F.when(up.rlike(p), name) for name, p in REGISTERS.items()], *[F.when(letter == x, name) for x, name in NAMED.items()])


def entity_of(c: Column, series: Column, sample: Column) -> Column:
    """project, series or sample: by the beginning of the id, else by which ids the record has, else a project."""
    up = F.upper(F.trim(c))
    by_prefix = [F.when(F.coalesce(*[F.when(up.startswith(p), True) for p in prefixes], F.lit(False)), name) for name, prefixes in PREFIXES.items()]
    return F.coalesce(*by_prefix, F.when(series.isNotNull(), "series"), F.when(sample.isNotNull(), "sample"), F.lit("project"))


def download_url(c: Column) -> Column:
    """Where an accession's files are, NULL for ids of no such archive. GEO keeps a thousand series in a folder."""
    stub = F.concat(F.left(c, F.greatest(F.length(c) - 3, F.lit(3))), F.lit("nnn"))
    geo = F.concat(F.lit("https://ftp.ncbi.nlm.nih.gov/geo/series/"), stub, F.lit("/"), c, F.lit("/suppl/"))
    return (
        F.when(c.rlike(r"^GSE\d+$"), geo)
        .when(family_of(c).isNotNull(), F.concat(F.lit("https://www.ebi.ac.uk/ena/browser/view/"), c))
        .when(c.rlike(r"^E-(MTAB|ANND)-\d+$"), F.concat(F.lit("https://www.ebi.ac.uk/biostudies/arrayexpress/studies/"), c))
    )
