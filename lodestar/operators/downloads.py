"""Where the files of records are, by archive and kind of file, and what a request for files comes to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Addresses by source: kind of file -> (column, what it begins with, template). {id} is the column's value; {thousand} a GEO
#: folder of a thousand series; {run} the folder of a sequencing run. Archives' own formats (fixed values).
ADDRESSES = {
    "cellxgene": {"h5ad": ("h5ad_url", "", "{id}"), "rds": ("rds_url", "", "{id}"), "explorer": ("explorer_url", "", "{id}")},
    "geo": {
        "supplementary": ("project_id", "GSE", "https://ftp.ncbi.nlm.nih.gov/geo/series/{thousand}/{id}/suppl/"),
        "geo_soft": ("project_id", "GSE", "https://ftp.ncbi.nlm.nih.gov/geo/series/{thousand}/{id}/soft/{id}_family.soft.gz"),
        "geo_page": ("project_id", "GSE", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc={id}"),
    },
    "ncbi": {
        "fastq": ("sample_id", "SRR", "ftp://ftp.sra.ebi.ac.uk/vol1/fastq/{run}/"), "sra_page": ("series_id", "SRP", "https://www.ncbi.nlm.nih.gov/sra/?term={id}"),
        "bioproject_page": ("project_id", "PRJNA", "https://www.ncbi.nlm.nih.gov/bioproject/{id}"),
    },
    "ebi": {
        "arrayexpress_page": ("project_id", "E-", "https://www.ebi.ac.uk/biostudies/arrayexpress/studies/{id}"),
        "sdrf": ("project_id", "E-", "https://www.ebi.ac.uk/biostudies/files/{id}/{id}.sdrf.txt"), "idf": ("project_id", "E-", "https://www.ebi.ac.uk/biostudies/files/{id}/{id}.idf.txt"),
    },
    "hca": {"hca_portal": ("access_url", "", "{id}")},
    "ega": {"ega_metadata": ("project_id", "EGA[DS]", "https://ega-archive.org/datasets/{id}")},
}


def _address(template: str, c: Column) -> Column:
    thousand = F.concat(F.left(c, F.length(c) - 3), F.lit("nnn"))
    run = F.concat_ws("/", F.left(c, F.lit(6)), F.when(F.length(c) > 9, F.right(c, F.lit(3))), c)
    parts = {"{id}": c, "{thousand}": thousand, "{run}": run}
    return F.concat(*[parts.get(p, F.lit(p)) for p in re.split(r"(\{\w+\})", template) if p])


def options(source: str = "source") -> Column:
    """An array of (file_type, url) of a record: what its source offers for the ids and addresses that it has."""
    found = []
    for name, kinds in ADDRESSES.items():
        for kind, (column, begin, template) in kinds.items():
            c = F.nullif(F.col(column), F.lit(""))
            there = (F.col(source) == name) & c.rlike(f"^{begin}")
            found.append(F.when(there, F.struct(F.lit(kind).alias("file_type"), _address(template, c).alias("url"))))
    return F.array_compact(F.array(*found))


def requested(asked: DataFrame, records: DataFrame, types: list[str], most: int = 300) -> DataFrame:
    """(id, file_type, url, state) of a request. asked: (place, id, url, file_type), ids with addresses that came with some of
    them; records: (id, options). Each id counts once, the first `most` of them. An id's files of the types asked for
    are `matched`; where there are none the address that came with it is `inline`; where there is none either the types
    that it has are named as `unmatched`, and ids of no record are `unresolved`."""
    first = asked.filter("id <> ''").groupBy("id").agg(F.min("place").alias("place"), F.max_by(F.struct("url", "file_type"), F.when(F.col("url") != "", F.col("place"))).alias("inline"))
    some = first.withColumn("turn", F.row_number().over(Window.orderBy("place", "id"))).filter(F.col("turn") <= most)
    x = some.join(records.select("id", "options"), "id", "left")
    own = F.filter(F.coalesce("options", F.array().cast("array<struct<file_type:string,url:string>>")), lambda o: o["url"].isNotNull())
    wanted = F.filter(own, lambda o: o["file_type"].isin(types))
    row = lambda kind, url, state: F.array(F.struct(kind.alias("file_type"), url.alias("url"), F.lit(state).alias("state")))
    none = F.lit(None).cast("string")
    found = (
        F.when(F.size(wanted) > 0, F.transform(wanted, lambda o: F.struct(o["file_type"].alias("file_type"), o["url"].alias("url"), F.lit("matched").alias("state"))))
        .when(F.col("inline.url").isNotNull(), row(F.coalesce("inline.file_type", F.lit("file")), F.col("inline.url"), "inline"))
        .when(F.size(own) > 0, row(F.array_join(F.array_sort(F.array_distinct(F.transform(own, lambda o: o["file_type"]))), ","), none, "unmatched"))
        .otherwise(row(none, none, "unresolved"))
    )
    return x.select("id", F.inline(found))
