"""Predicted patches that are repaired where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diff as D
from .versioned import VersionedTable

REPORT = "selected long, repaired long, already_valid long, unrepairable long, deficits map<int,long>, selection string, dry_run boolean, written boolean"


def repair_in_place(table: VersionedTable, reported: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """Puts back what truncated diffs have lost, in one new version of the table; a report of one row.

    The table has id, diff and patch_bytes, which is brought up to date where it is not null. Diffs are those of the `reported`
    (id) rows, ids that the table misses raising, or else all whose hunks are shorter than their headers say. Null
    ids and diffs that cannot be repaired stay as they are. A dry run, and a run without changes, writes nothing."""
    rows = table.read().where("id IS NOT NULL").withColumn("r", D.repair(F.col("diff")))
    broken = F.col("r.problem").isNotNull() | (F.col("r.deficit") != 0)
    if reported is None:
        chosen = rows.where((F.coalesce("diff", F.lit("")) != "") & broken)
    else:
        ids = reported.select(F.col("id").cast("string").alias("id")).distinct()
        if missing := [r["id"] for r in ids.join(rows.select("id"), "id", "left_anti").orderBy("id").limit(20).collect()]:
            raise ValueError(f"reported ids are not in the table: {missing}")
        chosen = rows.join(ids, "id", "left_semi")
    what = F.when(~broken, "valid").when(F.col("r.problem").isNotNull(), "unrepairable").otherwise("repaired")
    counts = {(r["what"], r["deficit"]): r["count"] for r in chosen.groupBy(what.alias("what"), F.when(what == "repaired", F.col("r.deficit")).alias("deficit")).count().collect()}  # one row a number of lost lines
    total = lambda w: sum(n for (x, _), n in counts.items() if x == w)
    written = not dry_run and total("repaired") > 0
    if written:
        size = F.when(F.col("patch_bytes").isNotNull(), F.octet_length("r.repaired").cast("long")).alias("patch_bytes")
        new = {"diff": F.col("r.repaired").alias("diff"), "patch_bytes": size}
        table.upsert(chosen.where(what == "repaired").select(*(new.get(c, F.col(c)) for c in table.read().columns)))
    deficits = {d: n for (x, d), n in sorted(counts.items(), key=lambda p: p[0][1] or 0) if x == "repaired"}
    row = (sum(counts.values()), total("repaired"), total("valid"), total("unrepairable"), deficits, "scan" if reported is None else "report", dry_run, written)
    return rows.sparkSession.createDataFrame([row], REPORT)
