"""Read headers: per-vendor patterns, the parts that vary, rebuilding from a template, and inference of a template."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vendor:
    """pattern: whole header without @, named by groups in order; common: groups that a file has once; template: of the parts."""

    pattern: str
    common: tuple[int, ...]
    template: str
    varying: tuple[int, ...]


# The header layouts of the supported instruments. In a template, $n is a group that a file has once and
# {n} the n-th part that varies.
VENDORS: dict[str, Vendor] = {
    "illumina": Vendor(r"^([^:\s]+):(\d+):([^:\s]+):(\d+):(\d+):(\d+):(\d+) (\d):([YN]):(\d+):(\S+)$", (1, 2, 3, 4), "$1:$2:$3:$4:{1}:{2}:{3} {4}:{5}:{6}:{7}", (5, 6, 7, 8, 9, 10, 11)),
    "old_illumina": Vendor(r"^([^:\s]+):(\d+):(\d+):(\d+):(\d+)#(\S+)/(\d)$", (1, 2), "$1:$2:{1}:{2}:{3}#{4}/{5}", (3, 4, 5, 6, 7)),
    "pacbio_hifi": Vendor(r"^(m[^/\s]+)/(\d+)/ccs$", (1,), "$1/{1}/ccs", (2,)),
    "pacbio_subread": Vendor(r"^(m[^/\s]+)/(\d+)/(\d+)_(\d+)$", (1,), "$1/{1}/{2}_{3}", (2, 3, 4)),
    "pacbio_clr": Vendor(r"^(m[^/\s]+)/(\d+)/(\d+)_(\d+)( RQ=[0-9.]+)?$", (1,), "$1/{1}/{2}_{3}{4}", (2, 3, 4, 5)),
    "ont": Vendor(r"^(.*)$", (), "{1}", (1,)),
    "sra": Vendor(r"^([A-Z]+\d+)\.(\d+) (\S+)( .*)?$", (1,), "$1.{1} {2}{3}", (2, 3, 4)),
    "illumina_sra": Vendor(r"^([A-Z]+\d+)\.(\d+(?:/[12])?) ([^:\s]+):(\d+):([^:\s]+):(\d+):(\d+):(\d+):(\d+)( .*)?$", (1, 3, 4, 5, 6), "$1.{1} $3:$4:$5:$6:{2}:{3}:{4}{5}", (2, 7, 8, 9, 10)),
    "pacbio_hifi_sra": Vendor(r"^([A-Z]+\d+)\.(\d+) (m[^/\s]+)/(\d+)/ccs( .*)?$", (1, 3), "$1.{1} $3/{2}/ccs{3}", (2, 4, 5)),
    "pacbio_clr_sra": Vendor(r"^([A-Z]+\d+)\.(\d+) (m[^/\s]+)/(\d+)/(\d+)_(\d+)( .*)?$", (1, 3), "$1.{1} $3/{2}/{3}_{4}{5}", (2, 4, 5, 6, 7)),
    "ont_sra": Vendor(r"^([A-Z]+\d+)\.(\d+)( .*)?$", (1,), "$1.{1}{2}", (2, 3)),
}
VENDORS["pacbio_ccs"] = VENDORS["pacbio_hifi"]


def group(header: Column, vendor: str, n: int) -> Column:
    return F.regexp_extract(header, VENDORS[vendor].pattern, n)


def matches(header: Column, vendor: str) -> Column:
    return header.rlike(VENDORS[vendor].pattern)


def parts(header: Column, vendor: str) -> Column:
    """The parts that vary; the whole header as one, if it is not of the vendor."""
    v = VENDORS[vendor]
    return F.when(matches(header, vendor), F.array(*[group(header, vendor, i) for i in v.varying])).otherwise(F.array(header))


def structure(header: Column, vendor: str) -> Column:
    """The template with the common parts of this header filled in; '' if it is not of the vendor."""
    v = VENDORS[vendor]
    out: Column = F.lit(v.template)
    for i in v.common:
        out = F.replace(out, F.lit(f"${i}"), group(header, vendor, i))
    return F.when(matches(header, vendor), out).otherwise(F.lit(""))


def rebuild(template: Column, pieces: Column) -> Column:
    """A template with its varying parts; without a template, the first part is the header."""
    filled = F.aggregate(F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), template,
                         lambda t, x: F.replace(t, F.concat(F.lit("{"), (x["i"] + 1).cast("string"), F.lit("}")), x["p"]))
    return F.when(template == "", pieces[0]).otherwise(filled)


def compressed(headers: DataFrame, vendor: str, col: str = "header") -> DataFrame:
    """structure, parts and exact of each header: where rebuilding would differ, the header is kept whole."""
    h = F.regexp_replace(F.col(col), "^@", "")
    made = headers.withColumn("structure", structure(h, vendor)).withColumn("parts", parts(h, vendor))
    exact = rebuild(F.col("structure"), F.col("parts")) == h
    return made.withColumn("exact", exact).withColumn("parts", F.when(exact, F.col("parts")).otherwise(F.array(h))).withColumn("structure", F.when(exact, F.col("structure")).otherwise(""))


DELIMITERS = (":", "/", ".", " ")


def vote_delimiter(headers: DataFrame, col: str = "header") -> DataFrame:
    """One row (delimiter, n): the most frequent of DELIMITERS, ties in that order; a blank if any header has key=value."""
    h = F.col(col)
    counts = headers.agg(*[F.sum(F.length(h) - F.length(F.replace(h, F.lit(d)))).alias(f"n{i}") for i, d in enumerate(DELIMITERS)], F.max(F.contains(h, F.lit("=")).cast("int")).alias("pairs"))
    rows = F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("order"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)])
    best = F.when(F.col("pairs") == 1, rows[3]).otherwise(F.array_max(rows))
    return counts.select(best.alias("b")).select(F.col("b.delimiter").alias("delimiter"), F.col("b.n").cast("long").alias("n"))


def field_stats(headers: DataFrame, delimiter: str, col: str = "header") -> DataFrame:
    """(pos, n_values, sample, n) of each field: one value is a literal of the template, several are a part that varies."""
    fields = headers.select(F.posexplode(F.split(F.col(col), f"[{delimiter}]")).alias("pos", "field"))
    return fields.groupBy("pos").agg(F.count_distinct("field").alias("n_values"), F.min("field").alias("sample"), F.count("*").alias("n"))


def flowcell_runs(headers: DataFrame, block: int = 1_000_000) -> DataFrame:
    """(flowcell, first_id, last_id, n) of each run of reads from one flowcell, by read_id.

    Runs are found within blocks of read ids; then the first and the last run of each block, two rows at most, are stitched
    over the blocks' edges, so no task sees more than a block or the edges.
    """
    within = Window.partitionBy("block").orderBy("read_id")
    rows = headers.select("flowcell", "read_id", F.floor(F.col("read_id") / block).alias("block"))
    rows = rows.withColumn("new", (~F.col("flowcell").eqNullSafe(F.lag("flowcell").over(within)) | F.lag("read_id").over(within).isNull()).cast("int"))
    runs = rows.withColumn("run", F.sum("new").over(within.rowsBetween(Window.unboundedPreceding, 0))).groupBy("block", "run")
    runs = runs.agg(F.first("flowcell").alias("flowcell"), F.min("read_id").alias("first_id"), F.max("read_id").alias("last_id"), F.count("*").alias("n"))
    runs = runs.withColumn("last_run", F.max("run").over(Window.partitionBy("block")))
    edges = runs.where("run = 1 or run = last_run")
    order = Window.orderBy("block", "run")
    goes_on = (F.col("run") == 1) & F.lag("flowcell").over(order).eqNullSafe(F.col("flowcell")) & F.lag(F.col("run") == F.col("last_run")).over(order)
    edges = edges.withColumn("whole", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.groupBy("whole").agg(F.first("flowcell").alias("flowcell"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n"))
    return runs.where("run > 1 and run < last_run").select("flowcell", "first_id", "last_id", "n").union(edges.select("flowcell", "first_id", "last_id", "n"))
