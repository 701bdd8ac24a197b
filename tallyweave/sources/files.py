"""Reading benchmark files: truth and prediction CSV trees, assay lists, shards, manifests, sequences, structures.

All CSV is read by Spark's own reader as text with explicit columns; types are given afterwards, so no value is guessed.
Headers differ between files of one tree: they are read by one job, and each group of files with one header is one scan.
"""

from __future__ import annotations

import csv
import json
import re
from contextlib import contextmanager
from pathlib import Path, PurePosixPath
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions import mutation, text
from tallyweave.session import cut
from tallyweave.sources import storage

#: Columns a prediction file may use, in order of precedence.
GROUP_COLUMNS = ["assay", "assay_id", "dataset"]
ITEM_COLUMNS = ["mutant", "annots", "mutation"]
#: Which files hold a task's truth, and the tasks whose files are groups in folders.
TRUTH_GLOBS = {"T3": ["*/anchor_*.csv"], "T4": ["*/single_context_combo*.csv"]}
NESTED = ("T3", "T4")
#: Where a group's file may name what is visible to a model, in order of precedence.
ANCHOR_SCORES = ["model_visible_anchor_DMS_score", "anchor_DMS_score"]


class SourceError(ValueError):
    """A file or folder that can't be read as asked; the message names it."""


def truth_root(spark: SparkSession, folder: str | Path, task: str) -> str:
    """The first of <folder>/<task>/norm_data, <folder>/norm_data and the folder itself that exists."""
    for p in (f"{folder}/{task}/norm_data", f"{folder}/norm_data", str(folder)):
        if storage.is_folder(spark, p):
            return p
    raise SourceError(f"no such folder: {folder}")


def truth_files(spark: SparkSession, root: str, task: str) -> list[str]:
    """Files of a task by its pattern, else nested CSV files, else flat ones, sorted."""
    for pattern in [*TRUTH_GLOBS.get(task, []), "*/*.csv", "*.csv"]:
        found = storage.listed(spark, f"{root}/{pattern}")
        if found:
            return found
    raise SourceError(f"no CSV files under {root}")


def first_existing(spark: SparkSession, paths: list[str | Path]) -> str | None:
    """The first of some paths that is there."""
    return next((str(p) for p in paths if storage.exists(spark, p)), None)


def _path() -> Column:
    # the metadata's path is an encoded URI, in which a plus stands for itself
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def plain_path(path: str | Path) -> str:
    """A path as rows of ``read_csv`` name it."""
    told = str(path)
    return told if ":" in told.split("/")[0] else f"file://{PurePosixPath(told)}" if told.startswith("/") else told


#: More files than this are read as folders where they make up whole ones, and what a small file counts as when files
#: are dealt to tasks (Spark's own 4 MB make a task of every few files).
MANY_FILES, SMALL_FILE = 32, 65536


def _scan(spark: SparkSession, files: list[str | Path]) -> tuple[list[str], dict]:
    """Paths and reader options that stand for these files: the folders where these are all their CSV files, as every path that is
    named by itself is looked up by itself."""
    told = [str(f) for f in files]
    folders = sorted({p.rpartition("/")[0] for p in told})
    if len(told) <= MANY_FILES or 2 * len(folders) > len(told) or not all(p.endswith(".csv") for p in told):
        return told, {}
    options = {"pathGlobFilter": "*.csv"}
    # a folder's path is a pattern to the reader
    if any(set(f) & set("*?[]{}\\") for f in folders):
        return told, {}
    found = spark.read.schema("value string").options(**options).text(folders)._jdf.inputFiles()
    there = {_bare(unquote(p)) for p in storage.joined(spark, found)}
    return (folders, options) if there == {_bare(p) for p in told} else (told, {})


def _bare(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


@contextmanager
def small_files(spark: SparkSession):
    """Scans that run inside put many small files into one task."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(SMALL_FILE))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def headers(spark: SparkSession, files: list[str | Path]) -> dict[str, list[str]]:
    """Column names of each file, by path as rows name it: the fields of its first line, read by one job."""
    places, options = _scan(spark, files)
    lines = spark.read.schema("value string").options(**options).text(places).select(_path().alias("path"), "value", F.monotonically_increasing_id().alias("i"), F.col("_metadata.file_block_start").alias("start"))
    with small_files(spark):
        first = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "i").alias("line")).collect()
    found = {r["path"]: next(csv.reader([r["line"].lstrip("\ufeff").rstrip("\r")]), []) for r in first}
    if len(found) < len(files):
        # an empty file has no line at all
        raise SourceError(f"{len(files) - len(found)} files without a header under {PurePosixPath(str(files[0])).parent}")
    return found


def choose(names: list[str], aliases: list[str], requested: str | None = None) -> str | None:
    """The requested column if it is there, else the first alias that is; an absent requested one gives None."""
    if requested is not None:
        return requested if requested in names else None
    return next((a for a in aliases if a in names), None)


def read_group(spark: SparkSession, names: list[str], members: list[str], index: bool = False, multi_line: bool = True) -> DataFrame:
    """Files that share a header, in one scan: text columns and path, with ``index`` also input_index.

    Of repeated names the last counts. Empty and missing fields are empty texts, ``NA`` stays text, fields beyond the header are
    dropped. ``multi_line`` keeps line breaks inside quotes and makes a file one task; without it large files are split.
    input_index is a record's place in its file, from 0.
    """
    kept = {n: i for i, n in enumerate(names)}
    schema = ", ".join(f"_c{i} string" for i in range(len(names)))
    places, found = _scan(spark, members)
    options = found | {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8"}
    scan = spark.read.schema(schema).options(**options).csv(places)
    fields = [F.coalesce(f"_c{i}", F.lit("")).alias(n) for n, i in kept.items()]
    if not index:
        return scan.select(*fields, _path().alias("path"))
    rows = scan.select(*fields, _path().alias("path"), F.monotonically_increasing_id().alias("_i"))
    first = rows.groupBy("path").agg(F.min("_i").alias("_first"))
    return rows.join(first, "path").select(*kept, "path", (F.col("_i") - F.col("_first")).alias("input_index"))


def read_csv(spark: SparkSession, files: list[str | Path], keep: list[str] | None = None, index: bool = True, multi_line: bool = True) -> DataFrame:
    """All files as text columns, each group of files with one header by one scan; see read_group."""
    return _read_groups(spark, _by_header(spark, files), keep, index, multi_line)


def _read_groups(spark: SparkSession, groups: dict[tuple[str, ...], list[str]], keep: list[str] | None, index: bool, multi_line: bool = True) -> DataFrame:
    out = None
    for names, members in groups.items():
        part = read_group(spark, list(names), members, index, multi_line)
        part = part.select(*[c for c in part.columns if keep is None or c in keep or c in ("path", "input_index")])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise SourceError("no files")
    return out


def _by_header(spark: SparkSession, files: list[str | Path]) -> dict[tuple[str, ...], list[str]]:
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in sorted(headers(spark, files).items() if files else ()):
        if not names:
            raise SourceError(f"{path}: no header")
        groups.setdefault(tuple(names), []).append(path)
    return groups


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.csv(\.gz)?\z", "")


def path_group(path: Column, task: str, nested: bool) -> Column:
    """The group a file stands for: its stem, for nested files the stem alone with ``__`` read as ``|`` if it has any, else the
    folder with the task (T3, T4) or with the stem."""
    if not nested:
        return stem(path)
    parent = F.element_at(F.split(path, "/"), -2)
    other = F.concat(parent, F.lit(f"_{task}")) if task in NESTED else F.concat_ws("|", parent, stem(path))
    return F.when(F.contains(stem(path), F.lit("__")), F.replace(stem(path), F.lit("__"), F.lit("|"))).otherwise(other)


def truth(spark: SparkSession, folder: str | Path, task: str, item: str = "mutant") -> DataFrame:
    """Raw truth rows (grp, item, score as text, path) of a task's files.

    T1 and T2 are keyed by file stem, T3 and T4 by the one candidate_group_id of a file, or without any by its folder and the
    task. Refused are a file without the item or the score column, one without a valid row, one with several group ids, and two
    files of one group.
    """
    files = truth_files(spark, truth_root(spark, folder, task), task)
    groups = _by_header(spark, files)
    for names, members in groups.items():
        lacking = {item, "DMS_score"} - set(names)
        if lacking:
            raise SourceError(f"{members[0]}: no column {sorted(lacking)}")
    wanted = [item, "DMS_score", "candidate_group_id"]
    with small_files(spark):
        rows = cut(_read_groups(spark, groups, wanted, index=False))
    own = text.python_nonblank(F.col("candidate_group_id")) if "candidate_group_id" in rows.columns and task in NESTED else F.lit(None).cast("string")
    valid = text.python_nonblank(F.col(item)).isNotNull() & text.python_float(F.col("DMS_score")).isNotNull()
    # one row a file
    told = rows.groupBy("path").agg(F.min(own).alias("grp"), F.max(own).alias("last"), F.count_if(valid).alias("n_valid"))
    fallback = F.concat(F.element_at(F.split("path", "/"), -2), F.lit(f"_{task}")) if task in NESTED else stem(F.col("path"))
    told = cut(told.withColumn("several", F.coalesce(F.col("grp") != F.col("last"), F.lit(False))).withColumn("grp", F.coalesce("grp", fallback)).drop("last"))
    bad = told.filter("several OR n_valid = 0").orderBy("path").first()
    if bad:
        raise SourceError(f"{bad['path']}: {'several group ids' if bad['several'] else 'no valid truth row'}")
    lacking = len(files) - told.count()
    if lacking:
        raise SourceError(f"{lacking} files without rows")
    twice = told.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("grp").first()
    if twice:
        raise SourceError(f"{twice['grp']}: {twice['n']} files of one group")
    return rows.join(told.select("path", "grp"), "path").select("grp", F.col(item).alias("item"), F.col("DMS_score").alias("score"), "path")


def typed_truth(rows: DataFrame) -> DataFrame:
    """(grp, item, score) with blank items and non-finite scores as null."""
    return rows.select("grp", text.python_nonblank(F.col("item")).alias("item"), text.python_float(F.col("score")).alias("score"))


def predictions(spark: SparkSession, place: str | Path, task: str, group: str | None = None, item: str | None = None, score: str = "score", rank: str = "rank") -> DataFrame:
    """Predictions (grp, item, order_value, input_index, source) of a file or of all CSV files under a folder.

    Larger scores are better; without a score column smaller ranks are; without either the order of lines counts. A file right
    below the folder without a group column stands for the group its name tells. A file further down always does, whatever
    columns it has, and so does a ``_random_multi`` file of T2 unless a group column is asked for. Rows with a blank group or
    item are left out; then an order value that isn't finite raises when it is read.
    """
    folder = storage.is_folder(spark, place)
    files = storage.below(spark, place, ".csv") if folder else [str(place)]
    if not files:
        raise SourceError(f"no CSV files under {place}")
    top = PurePosixPath(str(place)).name
    out = None
    for names, members in _by_header(spark, files).items():
        g, i = choose(list(names), GROUP_COLUMNS, group), choose(list(names), ITEM_COLUMNS, item)
        if i is None or (g is None and not folder):
            raise SourceError(f"{members[0]}: no {'item' if i is None else 'group'} column")
        rows = read_group(spark, list(names), members, index=True)
        grp = text.group_id(text.python_strip(F.col(g))) if g else F.lit(None).cast("string")
        if folder:
            deep = F.element_at(F.split("path", "/"), -2) != F.lit(top)
            forced = deep | F.lit(task == "T2" and group is None) & F.endswith(stem(F.col("path")), F.lit("_random_multi")) | F.lit(g is None)
            default = text.group_id(F.when(deep, path_group(F.col("path"), task, True)).otherwise(stem(F.col("path"))))
            grp = F.when(forced, default).otherwise(grp)
        rows = rows.withColumn("_g", grp).withColumn("_m", text.python_nonblank(F.col(i))).filter("_g IS NOT NULL AND _m IS NOT NULL")
        column = score if score in names else rank if rank in names else None
        if column:
            value = text.python_float(F.col(column))
            wrong = F.raise_error(F.concat(F.lit(f"bad {column} in "), F.col("path"), F.lit(":"), (F.col("input_index") + 2).cast("string"))).cast("double")
            value = F.when(value.isNull() & F.col("_g").isNotNull() & F.col("_m").isNotNull(), wrong).otherwise(-value if column == score else value)
        else:
            value = (F.col("input_index") + 1).cast("double")
        part = rows.select(
            F.col("_g").alias("grp"), F.col("_m").alias("item"), value.alias("order_value"), "input_index",
            F.concat_ws(":", file_name(F.col("path")), (F.col("input_index") + 2).cast("string")).alias("source"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def top_k(task: str, asked: int | None = None) -> int:
    """How many of a ranking count: what is asked for, except that in T2 to T4 asking for 40 or nothing means 5."""
    if asked is not None and asked <= 0:
        raise ValueError("top_k has to be positive")
    if task == "T1":
        return asked or 40
    return 5 if asked in (None, 40) else asked


def assays(spark: SparkSession, path: str | Path) -> DataFrame:
    """Assays of a list file: the last row of a repeated id counts; blank descriptions read ``unknown``; blank ids go."""
    rows = read_csv(spark, [path])
    known = rows.filter(text.python_nonblank(F.col("assay_id")).isNotNull())
    rest = [c for c in rows.columns if c not in ("assay_id", "path", "input_index")]
    last = known.groupBy(text.python_strip(F.col("assay_id")).alias("assay_id")).agg(F.max_by(F.struct(*rest), "input_index").alias("r")).select("assay_id", "r.*")
    filled = [F.coalesce(text.python_nonblank(F.col(c)), F.lit("unknown")).alias(c) if c in ("primary_task_class", "fitness_type", "readout_subclass") else F.col(c) for c in rest]
    return last.select("assay_id", *filled)


def first_filled(columns: list[str], otherwise: str = "unknown") -> Column:
    """The first of some columns that isn't blank, stripped."""
    return F.coalesce(*[text.python_nonblank(F.col(c)) for c in columns], F.lit(otherwise))


def candidates(spark: SparkSession, path: str | Path) -> DataFrame:
    """Non-blank mutants of a candidate list in file order; a list without any is refused."""
    rows = read_csv(spark, [path]).select("input_index", text.python_nonblank(F.col("mutant")).alias("mutant")).dropna()
    if rows.isEmpty():
        raise SourceError(f"{path}: no candidates")
    return rows.orderBy("input_index")


def candidate_index(files: DataFrame, records: DataFrame, path: str = "path", listed: str = "candidate_path") -> DataFrame:
    """``files`` with the assay whose record names the file: paths of both sides are brought into one form and joined.

    A file that no record names keeps nulls.
    """
    form = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), "^file:/+", "/"), r"/\.(?=/|\z)", ""), "(?<=.)//+", "/")
    known = records.filter(text.python_nonblank(F.col(listed)).isNotNull()).groupBy(form(listed).alias("_p")).agg(F.min("assay_id").alias("assay_id"))
    return files.withColumn("_p", form(path)).join(known, "_p", "left").drop("_p")


def visible_context(spark: SparkSession, path: str | Path) -> DataFrame:
    """(mutant, visible_score) of a context file, whichever of the two score columns it has."""
    names = next(iter(headers(spark, [path]).values()))
    column = choose(names, ["model_visible_DMS_score", "DMS_score"])
    if column is None:
        raise SourceError(f"{path}: no score column")
    rows = read_csv(spark, [path], index=False)
    return rows.select(text.python_nonblank(F.col("mutant")).alias("mutant"), text.python_float(F.col(column)).alias("visible_score")).dropna()


def windowed(df: DataFrame, order: list, start: int = 0, most: int | None = None) -> DataFrame:
    """Rows ``start``, ``start`` + 1, ... of an order, ``most`` of them; all from ``start`` on if that is None."""
    out = df.orderBy(*order)
    out = out.offset(start) if start else out
    return out if most is None else out.limit(most)


def group_files(spark: SparkSession, folder: str | Path, task: str, records: DataFrame, assays_from: int = 0, most_assays: int | None = None, groups_from: int = 0, most_groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups (path, source_assay, grp, anchor_mutant, anchor_score, context_path) and their items (path, input_index, item).

    ``records`` is (assay_id, assay_no); a window of them by number is used, then a window of the groups by assay and path. T1 and
    T2 files lie flat and are keyed by their first group id or their stem (T2: ``*_random_multi.csv``, whose assay is the stem
    without that); T3 and T4 files lie in a folder for each assay and have to hold exactly one group id. T3 files have to show an
    anchor and its score; T4 files name their context, else it lies beside them. A file without candidates is refused.
    """
    root = f"{folder}/norm_data"
    globs = {"T2": "*_random_multi.csv", "T3": "*/anchor_*.csv", "T4": "*/single_context_combo*.csv"}
    files = storage.listed(spark, f"{root}/{globs.get(task, '*.csv')}")
    if not files:
        raise SourceError(f"no files of {task} under {root}")
    visible = ["anchor_mutant", *ANCHOR_SCORES, "single_mutant_context_path"]
    rows = read_csv(spark, files, ["candidate_group_id", "mutant", *visible])
    for c in ("candidate_group_id", *visible):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    nested = task in NESTED
    assay = F.element_at(F.split("path", "/"), -2) if nested else F.regexp_replace(stem(F.col("path")), r"_random_multi\z", "") if task == "T2" else stem(F.col("path"))
    chosen = windowed(records, ["assay_no"], assays_from, most_assays).select(F.col("assay_id").alias("source_assay"), "assay_no")
    rows = cut(rows.withColumn("source_assay", assay).join(F.broadcast(chosen) if most_assays else chosen, "source_assay"))
    # the first row of a file that has a value has the value, an alias before the next one
    first = lambda c: F.min_by(text.python_nonblank(F.col(c)), F.when(text.python_nonblank(F.col(c)).isNotNull(), F.col("input_index")))
    own = text.python_nonblank(F.col("candidate_group_id"))
    told = rows.groupBy("path", "source_assay", "assay_no").agg(
        F.min(own).alias("grp"), F.max(own).alias("last"), first("candidate_group_id").alias("first_grp"), F.count_if(text.python_nonblank(F.col("mutant")).isNotNull()).alias("n_items"),
        first("anchor_mutant").alias("anchor_mutant"), F.coalesce(*[first(c) for c in ANCHOR_SCORES]).alias("anchor_score"), first("single_mutant_context_path").alias("context_path"),
    )
    told = windowed(told, ["assay_no", "path"], groups_from, most_groups)
    why = F.when(F.col("n_items") == 0, "no candidates")
    if nested:
        why = F.coalesce(F.when(F.col("grp").isNull() | (F.col("grp") != F.col("last")), "not exactly one group id"), why)
        why = F.coalesce(why, F.when(F.lit(task == "T3") & (F.col("anchor_mutant").isNull() | F.col("anchor_score").isNull()), "no visible anchor"))
    else:
        told = told.withColumn("grp", F.coalesce("first_grp", stem(F.col("path"))))
    told = cut(told.withColumn("why", why))
    bad = told.filter("why IS NOT NULL").orderBy("path").first()
    if bad:
        raise SourceError(f"{bad['path']}: {bad['why']}")
    beside = F.concat(F.regexp_replace("path", "[^/]*$", ""), F.lit("single_mutant_context.csv"))
    up = plain_path(PurePosixPath(str(folder)).parent)
    place = F.coalesce(F.concat(F.lit(f"{up}/"), F.col("context_path")), beside) if task == "T4" else F.lit(None).cast("string")
    groups = told.select("path", "source_assay", "grp", "anchor_mutant", "anchor_score", place.alias("context_path"))
    items = rows.join(told.select("path"), "path", "left_semi").select("path", "input_index", text.python_nonblank(F.col("mutant")).alias("item")).dropna()
    return groups, items


def shards(spark: SparkSession, folder: str | Path, columns: list[str] | None = None, schema_digest: str | None = None, dataset: dict | None = None) -> DataFrame:
    """Rows of all shards that have a manifest and a CSV file; refused unless the manifests agree and are complete.

    With ``columns`` each file has to have exactly these, in order; with ``schema_digest`` each run configuration has to name
    it; with ``dataset`` (its manifest) each shard has to target it. A configuration's own digest has to be right.
    """
    manifests = {p: json.loads(storage.read_text(spark, p)) for p in storage.listed(spark, f"{folder}/shard_*.json")}
    if not manifests:
        raise SourceError(f"no shards in {folder}")
    numbers = sorted(int(m["shard_id"]) for m in manifests.values())
    counts = {int(m["num_shards"]) for m in manifests.values()}
    if len(counts) != 1 or numbers != list(range(counts.pop())):
        raise SourceError(f"{folder}: shard numbers are incomplete: {numbers}")
    for what in ("dataset_id", "dataset_hash", "run_config_sha256"):
        if len({json.dumps(m.get(what)) for m in manifests.values()}) != 1:
            raise SourceError(f"{folder}: shards differ in {what}")
        if dataset and what != "run_config_sha256" and any(m.get(what) != dataset[what] for m in manifests.values()):
            raise SourceError(f"{folder}: a shard targets another dataset")
    if any(m.get("partial_run") for m in manifests.values()):
        raise SourceError(f"{folder}: a shard is partial")
    for p, m in manifests.items():
        config = m.get("run_config")
        if config is not None and json_digest(config) != m.get("run_config_sha256") or schema_digest and (config or {}).get("output_schema_sha256") != schema_digest:
            raise SourceError(f"{p}: the run configuration's provenance differs")
    data = [p.removesuffix(".json") + ".csv" for p in manifests]
    for path, names in headers(spark, data).items():
        if columns is not None and names != columns:
            raise SourceError(f"{path}: columns differ")
    rows = read_csv(spark, data, index=False, multi_line=False)
    actual = {PurePosixPath(r["path"]).stem: r["n"] for r in rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
    for p, m in manifests.items():
        if actual.get(PurePosixPath(p).stem, 0) != int(m["samples"]):
            raise SourceError(f"{p}: {actual.get(PurePosixPath(p).stem, 0)} rows, not {m['samples']}")
    return rows


def json_digest(value) -> str:
    """SHA-256 of a value as JSON with sorted keys and without blanks."""
    import hashlib

    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def context_index(paths: DataFrame, sequences: DataFrame) -> DataFrame:
    """``sequences`` (sequence) with the path of the alignment whose query is that sequence, the first in order of paths.

    ``paths`` is (path, query). A sequence without alignment keeps a null.
    """
    first = paths.groupBy("query").agg(F.min("path").alias("path"))
    return sequences.join(first, sequences["sequence"] == first["query"], "left").drop("query")


def thetas(spark: SparkSession, path: str | Path, key: str, value: str = "theta") -> DataFrame:
    """(key, value) of a table of thresholds: keys once each, values inside (0, 1), else refused."""
    rows = read_csv(spark, [path], index=False).select(text.python_nonblank(F.col(key)).alias(key), text.python_float(F.col(value)).alias(value))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    bad = rows.filter(F.col(key).isNull() | (F.col("n") > 1) | ~F.coalesce((F.col(value) > 0) & (F.col(value) < 1), F.lit(False))).first()
    if bad:
        raise SourceError(f"{path}: {bad[key]} is repeated or its value isn't inside (0, 1)")
    return rows.drop("n")


def line_count(spark: SparkSession, path: str | Path) -> int:
    """Lines of a text file; 0 where there is none."""
    return spark.read.text(str(path)).count() if storage.exists(spark, path) else 0


def manifest(spark: SparkSession, path: str | Path) -> DataFrame:
    return spark.read.option("multiLine", True).json(str(path))


def alignment_query(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, query): the first record of alignment files without insertions and gaps."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    first = F.try_element_at(F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "\r", "")), "\n>", -1), lambda x: F.btrim(x, F.lit(" \n")) != ""), F.lit(1))
    return rows.select("path", F.regexp_replace(F.substring(first, F.instr(first, "\n") + 1, F.lit(2147483647)), r"[a-z.\-\s]", "").alias("query"))


def multi_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, place, header, sequence) of FASTA files: headers with their mark, upper case, each gap as ``<pad>``.

    The last record of a repeated header counts, at the place of its first, counted from 0. Lines before a header go.
    """
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.filter(F.transform(F.split("value", r"\r\n?|\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    parts = F.filter(F.split(F.array_join(lines, "\n"), "\n(?=>)", -1), lambda x: F.startswith(x, F.lit(">")))
    found = rows.select("path", F.posexplode(parts).alias("place", "part")).select("path", "place", F.split("part", "\n", -1).alias("l"))
    letters = F.upper(F.array_join(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), ""))
    found = found.select("path", "place", F.get("l", F.lit(0)).alias("header"), F.regexp_replace(letters, "[-.]", "<pad>").alias("sequence"))
    return found.groupBy("path", "header").agg(F.min("place").alias("place"), F.max_by("sequence", "place").alias("sequence")).select("path", "place", "header", "sequence")


def variants(spark: SparkSession, path: str | Path) -> DataFrame:
    """(input_index, mutation, eve_score) of a variants file; without any score all are null, else each row has to have a number."""
    names = next(iter(headers(spark, [path]).values()))
    if "mutation" not in names:
        raise SourceError(f"{path}: no column mutation")
    rows = read_csv(spark, [path])
    if "eve_score" not in names:
        return rows.select("input_index", "mutation", F.lit(None).cast("double").alias("eve_score"))
    number = F.when(F.col("eve_score").rlike(r"(?i)^\s*([+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?inf(inity)?|nan)\s*\z"), F.trim("eve_score").try_cast("double"))
    counts = rows.agg(F.count_if(F.col("eve_score") != "").alias("given"), F.count_if(number.isNull()).alias("bad")).first()
    if counts["given"] and counts["bad"]:
        raise SourceError(f"{path}: {counts['bad']} rows have no number in eve_score")
    return rows.select("input_index", "mutation", number.alias("eve_score"))


def pdb_sequence(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sequence, sound) from the alpha carbons of PDB files: fixed columns, one model, one chain, residues from 1 on."""
    #: Three-letter names of the residues.
    names = dict(zip("ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR".split(), mutation.RESIDUES))
    one = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    models = rows.groupBy("path").agg(F.count_if(F.startswith("value", F.lit("MODEL "))).alias("models"))
    atoms = rows.filter(F.substring("value", 1, 6).isin("ATOM  ") & (F.trim(F.substring("value", 13, 4)) == "CA") & F.substring("value", 17, 1).isin(" ", "A"))
    atoms = atoms.select("path", F.substring("value", 22, 1).alias("chain"), F.trim(F.substring("value", 23, 4)).try_cast("int").alias("number"), F.try_element_at(one, F.substring("value", 18, 3)).alias("residue"))
    found = atoms.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "residue"))), lambda x: F.coalesce(x["residue"], F.lit("X"))), "").alias("sequence"),
        F.countDistinct("chain").alias("chains"), F.min("number").alias("a"), F.max("number").alias("b"), F.count(F.lit(1)).alias("n"), F.countDistinct("number").alias("d"),
    )
    out = found.join(models, "path")
    return out.select("path", "sequence", ((F.col("chains") == 1) & (F.col("models") <= 1) & (F.col("a") == 1) & (F.col("b") == F.col("n")) & (F.col("d") == F.col("n"))).alias("sound"))


def backbone(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, chain, number, coordinates of N, CA, C, O) of the residues that have all four."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    name = F.trim(F.substring("value", 13, 4))
    atoms = rows.filter((F.substring("value", 1, 6) == "ATOM  ") & name.isin("N", "CA", "C", "O") & F.substring("value", 17, 1).isin(" ", "A"))
    at = F.array(*[F.trim(F.substring("value", k, 8)).try_cast("double") for k in (31, 39, 47)])
    keyed = atoms.select("path", F.substring("value", 22, 1).alias("chain"), F.trim(F.substring("value", 23, 4)).try_cast("int").alias("number"), name.alias("atom"), at.alias("at"))
    full = keyed.groupBy("path", "chain", "number").agg(*[F.first(F.when(F.col("atom") == a, F.col("at")), ignorenulls=True).alias(a) for a in ("N", "CA", "C", "O")])
    return full.dropna()


def parse_settings(content: str) -> dict[str, dict[str, object]]:
    """The plain part of YAML: sections of key: scalar and key: lists. Comments and blank lines are skipped."""
    out: dict[str, dict[str, object]] = {}
    section, key = out.setdefault("", {}), None
    for line in content.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        word = bare.strip()
        if word.startswith("- ") and key is not None:
            items = section[key] if isinstance(section[key], list) else []
            section[key] = [*items, word[2:].strip().strip("'\"")]
        elif not bare[0].isspace() and word.endswith(":"):
            section, key = out.setdefault(word[:-1], {}), None
        elif ":" in word:
            key, _, value = (x.strip() for x in word.partition(":"))
            section[key] = value.strip("'\"")
    return {k: v for k, v in out.items() if v}


def resolved(base: str | Path, value: str) -> str:
    """A path from a manifest, relative ones from the manifest's folder."""
    return value if PurePosixPath(value).is_absolute() else str(Path(base, value).resolve())
