"""Rows that fail to parse: every delivered line becomes a typed row or a reason why it cannot.

Lines are read strictly (functions.csvline) and once. A sound record is exploded into its cells (line, column, value), a broken
one into a single cell that says what is wrong with the record; cells are joined with a table of rules and validated. Errors
are aggregated per line, and clean lines are what an anti-join with them leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import csvline, mutation, text
from tallyweave.session import cut

#: Stands for the column of the one cell of a broken record.
RECORD = "(record)"
#: Which rule looks at which column, and the reason it gives. Five rows, so joining them is a constant-size broadcast.
RULES = [
    (RECORD, "quoting", "quoting"), (RECORD, "column_count", "column_count"),
    ("mutant", "blank", "blank_mutant"), ("mutant", "legal", "bad_mutant"), ("DMS_score", "number", "bad_score"),
]
#: Characters of all headers together up to which they are broadcast.
HEADERS_MOST = 4_000_000


def headers(lines: DataFrame) -> DataFrame:
    """(source_csv, names) of each file: the fields of its line 1, of the smallest line_id if there are several."""
    first = csvline.without_mark(csvline.line_body(F.col("raw_line")))
    heads = lines.filter(F.col("line_no") == 1).select("source_csv", csvline.fields(csvline.quote_pieces(first)).alias("names"), "line_id")
    return heads.groupBy("source_csv").agg(F.min_by("names", "line_id").alias("names"))


def read_records(lines: DataFrame) -> DataFrame:
    """Data lines (line_no > 1) with their header's names, their fields and what is broken about them.

    A line without a header has null names. A null line counts as an empty one, a null line_no as no data line. Headers are
    written and measured first: up to HEADERS_MOST characters they are broadcast and lines stay where they are; beyond
    that both meet in an equi-join on the file, where a file that holds most lines is split by the adaptive skew join.
    """
    heads = cut(headers(lines))
    size = heads.agg(F.sum(F.length("source_csv") + F.length(F.array_join("names", ",")))).first()[0] or 0
    body = lines.filter(F.col("line_no") > 1).select("line_id", "source_csv", "source_assay", "line_no", "raw_line")
    body = body.join(F.broadcast(heads) if size <= HEADERS_MOST else heads, "source_csv", "left")
    body = body.withColumn("pieces", csvline.quote_pieces(csvline.line_body(F.col("raw_line"))))
    read = body.select("line_id", "source_csv", "source_assay", "line_no", "names", csvline.sound(F.col("pieces")).alias("sound"), csvline.fields(F.col("pieces")).alias("cells"))
    fits = F.coalesce(F.size("names") == F.size("cells"), F.lit(False))
    return read.withColumn("broken", F.when(~F.col("sound"), "quoting").when(~fits, "column_count"))


def exploded_cells(records: DataFrame, columns: list[str]) -> DataFrame:
    """One row (line_id, source_assay, column, value) for each wanted column of each record of the right shape, and one whose
    value is the reason for each broken record.

    A wanted column the header lacks comes out with a null value; of repeated names the first counts.
    """
    place = lambda c: F.nullif(F.array_position(F.col("names"), F.lit(c)).cast("int"), F.lit(0))
    cell = lambda c, value: F.struct(F.lit(c).alias("column"), value.alias("value"))
    good = F.array(*[cell(c, F.try_element_at("cells", place(c))) for c in columns])
    return records.select("line_id", "source_assay", F.inline(F.when(F.col("broken").isNull(), good).otherwise(F.array(cell(RECORD, F.col("broken"))))))


def failing(cells: DataFrame, assays: DataFrame) -> DataFrame:
    """(line_id, reason) for each cell and each rule it fails.

    A missing mutant is a blank one, a missing score a bad score; an unknown assay or one without sequence makes the mutant
    bad. ``assays`` is the fixed list of assays and is broadcast.
    """
    wild = (
        assays.groupBy("assay_id")
        .agg(F.min("wildtype_sequence").alias("wt"))
        .select(F.col("assay_id").alias("source_assay"), mutation.flat_sequence(F.col("wt")).alias("wt"))
    )
    rules = cells.sparkSession.createDataFrame(RULES, "column string, rule string, reason string")
    checked = cells.join(F.broadcast(rules), "column").join(F.broadcast(wild), "source_assay", "left")
    value = text.strip(F.coalesce(F.col("value"), F.lit("")))
    found = mutation.parts(F.upper(value))
    fails = (
        F.when(F.col("column") == RECORD, F.col("value") == F.col("rule"))
        .when(F.col("rule") == "blank", value == "")
        .when(F.col("rule") == "legal", (value != "") & ~F.coalesce(mutation.legal(found, F.col("wt")), F.lit(False)))
        .when(F.col("rule") == "number", text.finite_number(F.col("value")).isNull())
    )
    return checked.filter(fails).select("line_id", "reason")


def errors(found: DataFrame) -> DataFrame:
    """(line_id, reasons): the different reasons of each line, in order."""
    return found.groupBy("line_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def _columns() -> list[str]:
    return sorted({c for c, _, _ in RULES} - {RECORD})


def violations(lines: DataFrame, assays: DataFrame) -> DataFrame:
    """(line_id, reason) for each data line and each reason that keeps it out.

    ``quoting`` and ``column_count`` stand alone; ``blank_mutant`` or ``bad_mutant`` and, beside them, ``bad_score``.
    """
    return errors(failing(exploded_cells(read_records(lines), _columns()), assays)).select("line_id", F.explode("reasons").alias("reason"))


def rejected(lines: DataFrame, assays: DataFrame) -> DataFrame:
    """One row for each rejected line: line_id, its reasons in order, and their number."""
    found = errors(failing(exploded_cells(read_records(lines), _columns()), assays))
    return found.select("line_id", F.array_join("reasons", ",").alias("reasons"), F.size("reasons").cast("bigint").alias("n_reasons"))


def clean_rows(lines: DataFrame, assays: DataFrame) -> DataFrame:
    """Typed truth rows of the lines without any reason against them. Records are parsed once and written as narrow rows."""
    names = ["candidate_group_id", "mutant", "DMS_score"]
    place = lambda c: F.nullif(F.array_position(F.col("names"), F.lit(c)).cast("int"), F.lit(0))
    records = read_records(lines)
    narrow = cut(records.select("line_id", "source_assay", "broken", F.lit(names).alias("names"), F.array(*[F.try_element_at("cells", place(c)) for c in names]).alias("cells")))
    kept = narrow.join(errors(failing(exploded_cells(narrow, _columns()), assays)), "line_id", "left_anti")
    return kept.select(
        "line_id", "source_assay", text.nonblank(F.col("cells")[0]).alias("candidate_group_id"), F.upper(text.strip(F.col("cells")[1])).alias("mutant"),
        text.finite_number(F.col("cells")[2]).alias("dms_score"),
    )
