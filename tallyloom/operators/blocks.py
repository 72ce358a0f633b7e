"""Product blocks of sheets: runs of rows that one anchor row speaks for.

Rows are numbered from 0 without gaps within (doc_id, sheet_no); everything is windows over a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as tx
from . import gates

SHEET = ["doc_id", "sheet_no"]
IGNORED = [*R.OUTPUT_COLUMNS, *R.GUIDE_COLUMNS, "SN", "S/N", "S.No", "Sr No", "Serial No"]


def row_text(headers: Column, cells: Column) -> Column:
    """Cells that hold something, without output and serial-number columns, joined by bars."""
    header = lambda i: F.coalesce(F.trim(F.get(headers, i)), F.lit(""))
    serial = lambda i: F.regexp_replace(F.lower(header(i)), "[^a-z0-9]", "").isin(*R.SERIAL_KEYS)
    own = F.transform(cells, lambda c, i: F.when((c != "") & ~header(i).isin(*IGNORED) & ~serial(i), c))
    return F.coalesce(F.array_join(F.array_compact(own), " | "), F.lit(""))


def context(title: Column, headers: Column, text: Column) -> Column:
    """title | first five headers | text, without blank parts."""
    heads = F.array_join(F.filter(F.slice(F.coalesce(headers, F.array().cast("array<string>")), 1, 5), lambda h: ~h.isin(*IGNORED)), " | ")
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(" | ", some(title), some(heads), some(text))


def sheet_kind(title: Column) -> Column:
    """What a sheet without anchors is about as a whole, from aggregates over its rows."""
    any_row = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    t = F.lower(F.first(title))
    text = F.lower("text")
    signals = sum((any_row(text.contains(s) | F.lower(title).contains(s)).cast("int") for s in R.FIREWALL_SIGNALS), F.lit(0))
    wall = any_row(text.rlike(R.FIREWALL_SHEET)) | t.rlike(R.FIREWALL_SHEET) | ((signals >= 2) & (any_row(text.rlike(R.FIREWALL_PORTS)) | t.rlike(R.FIREWALL_PORTS)))
    logs = any_row(text.rlike(R.LOGGING_SHEET)) | (any_row(text.rlike(R.LOGGING_WORDS[0])) & any_row(text.rlike(R.LOGGING_WORDS[1])))
    return (
        F.when(wall, "firewall")
        .when(t.contains("hardware based logging") | t.contains("logging solut"), "logging title")
        .when(logs, "logging rows")
        .when(t.contains("management") & t.contains("monitor"), "management")
        .when(t.contains("ssl") & t.contains("vpn"), "ssl vpn")
    )


def with_blocks(rows: DataFrame) -> DataFrame:
    """rows (SHEET, title, row_no, text) with start_row, anchor_row and end_row of the block that covers each
    (null where none does), first_start of its sheet, and in_block."""
    text, no = F.col("text"), F.col("row_no")
    filled = F.trim("text") != ""
    rows = rows.withColumns({"_anchor": filled & gates.anchor_text(text), "_heading": gates.section_only(text)})
    perimeter = F.lower("text").contains("perimeter firewall")
    first = lambda c: F.min(F.when(c, no))
    preferred = [first(tx.any_of(F.lower("text"), terms)).alias(f"_{k}") for k, terms in enumerate(R.PREFERRED.values())]
    sheets = rows.groupBy(*SHEET).agg(
        F.bool_or("_anchor").alias("_any"),
        F.bool_or(perimeter).alias("_perimeter"),
        first(perimeter | F.lower("text").contains("next generation firewall throughput")).alias("_wall"),
        sheet_kind(F.col("title")).alias("_kind"),
        first(filled).alias("_filled"),
        F.max("row_no").alias("_last"),
        *preferred,
    )
    chosen = None
    for k, name in enumerate(R.PREFERRED):
        hit = F.coalesce(F.col(f"_{k}"), F.col("_filled"))
        chosen = F.when(F.col("_kind") == name, hit) if chosen is None else chosen.when(F.col("_kind") == name, hit)
    sheets = sheets.select(*SHEET, "_last", F.when(~F.col("_any") & F.col("_perimeter"), F.col("_wall")).alias("_wall"), F.when(~F.col("_any") & ~F.col("_perimeter"), chosen).alias("_whole"))
    rows = rows.join(sheets, SHEET).withColumn("_anchor", F.col("_anchor") | F.coalesce(no == F.col("_wall"), F.lit(False)))
    w = Window.partitionBy(*SHEET).orderBy("row_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # a heading right before an anchor takes its place; in a run of headings every second one goes
    follows = F.coalesce(F.lag("_anchor").over(w) & F.lag("_heading").over(w), F.lit(False))
    rows = rows.withColumn("_opens", F.col("_anchor") & ~follows)
    rows = rows.withColumn("_run", F.last(F.when(F.col("_opens"), no), ignorenulls=True).over(upto))
    rows = rows.withColumn("_kept", F.col("_anchor") & ((no - F.col("_run")) % 2 == 0))
    rows = rows.withColumn("start_row", F.coalesce(F.last(F.when(F.col("_kept"), no), ignorenulls=True).over(upto), F.when(F.col("_whole").isNotNull(), F.lit(0))))
    block = Window.partitionBy(*SHEET, "start_row")
    heads = F.bool_or((no == F.col("start_row")) & F.col("_heading") & F.col("_whole").isNull()).over(block)
    behind = F.min(F.when((F.trim("text") != "") & (no > F.col("start_row")), no)).over(block)
    anchor = F.when(F.col("_whole").isNotNull(), F.col("_whole")).otherwise(F.when(heads, F.coalesce(behind, F.col("start_row"))).otherwise(F.col("start_row")))
    rows = rows.withColumn("anchor_row", F.when(F.col("start_row").isNotNull(), anchor)).withColumn("_end", F.max("row_no").over(block))
    whole_row = F.bool_or((no == F.col("anchor_row")) & gates.capacity_row(text) & F.col("_whole").isNull()).over(block)
    rows = rows.withColumn("end_row", F.when(F.col("start_row").isNotNull(), F.when(whole_row, F.col("anchor_row")).otherwise(F.col("_end"))))
    rows = rows.withColumn("first_start", F.min("start_row").over(Window.partitionBy(*SHEET)))
    rows = rows.withColumn("in_block", F.coalesce((no >= F.col("start_row")) & (no <= F.col("end_row")), F.lit(False)))
    return rows.drop("_anchor", "_heading", "_last", "_wall", "_whole", "_opens", "_run", "_kept", "_end")


def marked(parts: Column, primary: Column) -> Column:
    """``PRIMARY: text`` for the primary row, ``SPEC_ROW_n: text`` for others; parts: (row_no, text) in order."""
    mark = lambda s: F.when(s["row_no"] == primary, F.lit("PRIMARY")).otherwise(F.concat(F.lit("SPEC_ROW_"), (s["row_no"] + 1).cast("string")))
    return F.array_join(F.transform(parts, lambda s: F.concat(mark(s), F.lit(": "), s["text"])), " | ")


def parts_of(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """The texts of each group of a sheet in order; a block, a product's group or a sheet's table is one
    text in the end, so its rows are gathered."""
    held = rows.where(F.col("text") != "")
    return held.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("row_no", "text"))).alias(out))
