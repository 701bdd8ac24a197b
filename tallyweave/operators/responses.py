"""Model responses: finding the JSON in them, cleaning rankings, counting marks, filling prompts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import mutation

_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.IGNORECASE | re.DOTALL)


def find_json(text: str | None):
    """The first JSON object of a response: a fenced block, else the first balanced span that parses, else the whole text.

    Braces count wherever they stand, also inside strings. None if nothing parses or the text is null or empty.
    """
    if not text:
        return None

    def parsed(part: str):
        try:
            return True, json.loads(part)
        except (ValueError, RecursionError):
            return False, None

    fenced = _FENCED.search(text)
    if fenced:
        good, value = parsed(fenced.group(1))
        if good:
            return value
    depth, begin = 0, 0
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            begin = begin if depth else m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                good, value = parsed(text[begin : m.end()])
                if good:
                    return value
    return parsed(text)[1]


def _ranking(text: str | None) -> list[str] | None:
    value = find_json(text)
    ranking = value.get("ranking") if isinstance(value, dict) else None
    return [str(x).strip() for x in ranking] if isinstance(ranking, list) else None


def extracted_ranking(text: Column) -> Column:
    """The ranking of each response, members trimmed, blanks kept; null where there is none. Runs on Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_ranking)

    return run(text)


def _greedy(text: str | None) -> list[str]:
    bare = (text or "").strip()
    if "```" in bare:
        bare = re.sub(r"\A```(?:json)?", "", bare)
        bare = re.sub(r"```\Z", "", bare).strip()
    for part in (bare, bare[bare.find("{") : bare.rfind("}") + 1] if "{" in bare else ""):
        try:
            value = json.loads(part)
        except (ValueError, RecursionError):
            continue
        ranking = value.get("ranking", []) if isinstance(value, dict) else []
        return [w for w in (str(x).strip() for x in ranking) if w] if isinstance(ranking, (list, str, dict)) else []
    return []


def greedy_ranking(text: Column) -> Column:
    """The ranking of a response that is JSON as a whole, fences dropped, or else from its first to its last brace.

    Members are trimmed, blank ones dropped; an empty list where there is none. Runs on Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_greedy)

    return run(text)


def long_ranking(df: DataFrame, key: str, ranking: str) -> DataFrame:
    """(key, rank, mutant) of a ranking column; rank from 1."""
    return df.select(key, F.posexplode(ranking).alias("i", "mutant")).select(key, (F.col("i") + 1).alias("rank"), "mutant")


def closed_set(named: DataFrame, pool: DataFrame, key: str, group: str) -> DataFrame:
    """Judge each named mutant against its group's pool: kept (first legal naming), duplicate or outside, and its new rank.

    ``named`` is (key, group, rank, mutant), ``pool`` (group, mutant).
    """
    legal = named.join(pool.select(group, "mutant").distinct().withColumn("_legal", F.lit(True)), [group, "mutant"], "left")
    first = F.min("rank").over(Window.partitionBy(key, "mutant"))
    said = F.when(F.col("_legal").isNull(), "outside").when(F.col("rank") == first, "kept").otherwise("duplicate")
    out = legal.withColumn("verdict", said)
    new = F.count_if(F.col("verdict") == "kept").over(Window.partitionBy(key).orderBy("rank"))
    return out.select(key, group, "rank", "mutant", "verdict", F.when(F.col("verdict") == "kept", new).cast("int").alias("new_rank"))


def generated(named: DataFrame, key: str, k: int) -> DataFrame:
    """Per response: how many free proposals are accepted until ``k`` are, and why others before that aren't.

    ``named`` is (key, rank, mutant, wt) and may have ``measured``; a mutant has to be one substitution on ``wt``, and measured unless
    that is null or absent, which says that nothing is known of it. What stands after the k-th accepted doesn't count.
    """
    named = named if "measured" in named.columns else named.withColumn("measured", F.lit(None).cast("boolean"))
    legal = mutation.legal(mutation.parts(F.col("mutant"), "[+:]"), F.col("wt")) & ~F.col("mutant").rlike("[+:]")
    rows = named.withColumn("_legal", F.coalesce(legal, F.lit(False))).withColumn("_ok", F.col("_legal") & F.coalesce("measured", F.lit(True)))
    rows = rows.withColumn("_new", F.col("rank") == F.min("rank").over(Window.partitionBy(key, "mutant")))
    taken = F.count_if(F.col("_ok") & F.col("_new")).over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", taken).filter(F.col("_before") < k)
    return rows.groupBy(key).agg(
        F.count_if(F.col("_ok") & F.col("_new")).alias("accepted"), F.count_if(~F.col("_legal")).alias("invalid"), F.count_if(F.col("_ok") & ~F.col("_new")).alias("duplicate"),
        F.count_if(F.col("_legal") & ~F.col("_ok")).alias("not_measured"),
    )


def marks(text: Column, names: list[str]) -> dict[str, Column]:
    """How often each mark ``<name`` occurs, whatever its case."""
    return {n: F.regexp_count(text, F.lit(rf"(?i)<{n}\b")).alias(f"n_{n}") for n in names}


def mentions(text: Column, pattern: str) -> Column:
    """Distinct matches of a pattern's first group, sorted; spellings that differ in case stay apart."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def numbered_lines(items: Column) -> Column:
    """``1. first`` and so on, one a line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` places filled and doubled braces halved. A null value fills in nothing."""
    parts: list[Column] = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal.replace("{{", "{").replace("}}", "}")))
        if name:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def scored_lines(mutants: Column, scores: Column) -> Column:
    """``mutant: score``, one a line."""
    return F.array_join(F.transform(F.arrays_zip(mutants.alias("m"), scores.alias("s")), lambda x: F.concat(x["m"], F.lit(": "), x["s"])), "\n")


#: What is asked of a model, by task. Doubled braces stand for braces.
PROMPTS = {
    "T1": 'Sequence: {wt}\nName up to {k} single substitutions, best first, as {{"ranking": [...]}}',
    "T2": 'Sequence: {wt}\nReadout: {readout}\nOrder all candidates, best first, as {{"ranking": [...]}}\n{n} candidates follow, one a line.',
    "T3": 'Sequence: {wt}\nReadout: {readout}\nMeasured: {anchor}\nOrder all candidates, best first, as {{"ranking": [...]}}\n{n} candidates follow, one a line.',
    "T4": 'Sequence: {wt}\nReadout: {readout}\nSingle substitutions measured:\n{singles}\nOrder all candidates, best first, as {{"ranking": [...]}}\n{n} candidates follow, one a line.',
}


def prompted(task: Column, values: dict[str, Column]) -> Column:
    """The prompt of each row's task, filled; null for a task without one."""
    out = F.lit(None).cast("string")
    for name, template in PROMPTS.items():
        out = F.when(task == name, filled(template, values)).otherwise(out)
    return out


def written_predictions(rankings: DataFrame) -> DataFrame:
    """(assay, mutant, rank, model, response, usage_json) rows of (assay, ranking, model, usage_json); what describes the response stands on rank 1."""
    rows = rankings.select("assay", "model", "usage_json", F.to_json(F.struct(F.col("ranking"))).alias("response"), F.posexplode("ranking").alias("i", "mutant"))
    first = lambda c: F.when(F.col("i") == 0, F.col(c)).otherwise("").alias(c)
    return rows.select("assay", "mutant", (F.col("i") + 1).alias("rank"), first("model"), first("response"), first("usage_json"))

