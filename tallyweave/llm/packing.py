"""Filling containers of fixed capacity: mixture-controlled packing.

Each source's items stand in one queue, in the order of a hash, and the tokens before each item are known from prefix sums.
A part takes the same fraction of every queue, so it holds the sources in their target proportions up to an item each;
where an item reaches over a part's end, the next part starts with that deficit. Inside a part, deficit round-robin over the
queues fills window after window to the proportions and carries what a source is owed into the next window. Each window's
items are packed best-fit, longest first, into containers that earlier windows of the part left open too. No part needs
to see another one, and how many tokens and items a part has is bounded.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import tokens
from tallyweave.session import cut

#: Containers in a part and in a window; items in a part, where items are so small that it would have more; items in a bucket.
PART, WINDOW, ITEMS, BUCKET = 4000, 64, 500_000, 4096
_OUT = "limit_name string, container bigint, doc_id bigint, piece_no int, first_token bigint, n_tokens int, source string, window_no int"


def sizes(docs: DataFrame, key: str, text: str, source: str, names: list[str], folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(key, source, tokenizer, n_tokens) for each row and tokenizer; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, lot in tokens.batches_of(batch.column(1).to_pylist()):
                rows = batch.slice(start, len(lot))
                for name in names:
                    counts = pa.array(tokens.load(name, folder).counts(lot), pa.int64())
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([name] * len(lot), pa.string()), counts], names=[key, "source", "tokenizer", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, F.coalesce(F.col(source), F.lit("")).alias("source")).mapInArrow(run, f"{key} {kind}, source string, tokenizer string, n_tokens bigint")


def windows(queues: dict[str, deque], share: dict[str, float], owed: dict[str, float], quantum: float) -> Iterator[list]:
    """Deficit round-robin: lists of items (size first), each list a window filled to the shares. ``owed`` is carried on."""
    names = sorted(queues)
    for s in names:
        owed.setdefault(s, 0.0)
    while any(queues.values()):
        live = [s for s in names if queues[s]]
        whole = sum(share[s] for s in live) or 1.0
        taken = []
        for s in live:
            owed[s] += quantum * share[s] / whole
            queue = queues[s]
            while queue and queue[0][0] <= owed[s]:
                owed[s] -= queue[0][0]
                taken.append(queue.popleft())
        if taken:
            yield taken


class Bins:
    """Open containers by free space."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.count = capacity, [], 0

    def place(self, size: int) -> int:
        """Number of the fullest container that still takes ``size``, a new one if none does."""
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            free, number = self.free.pop(at)
        else:
            free, number = self.capacity, self.count
            self.count += 1
        if free > size:
            insort(self.free, (free - size, number))
        return number


def queued(sized: DataFrame, items: int) -> DataFrame:
    """Add ``before`` and ``of_source``: the tokens in front of each item in its source's queue, and those of the whole queue.

    A queue is cut by hash into buckets of about BUCKET items, the buckets into as many groups. Sums are taken over the groups of
    a queue, the buckets of a group and the items of a bucket, so no task sorts more than about the root of a queue's buckets,
    or a bucket. Equal rows may change places.
    """
    side = max(1, round((items / BUCKET) ** 0.5))
    place = F.xxhash64("doc_id", "n_tokens")
    rows = sized.withColumn("_h", place).withColumn("_g", F.pmod("_h", F.lit(side))).withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(side)))
    queue = ["tokenizer", "source"]
    ahead = lambda column, keys, *order: F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = rows.groupBy(*queue, "_g", "_b").agg(F.sum("n_tokens").alias("_n"))
    groups = buckets.groupBy(*queue, "_g").agg(F.sum("_n").alias("_n"))
    groups = groups.withColumn("_of_g", ahead("_n", queue, "_g")).withColumn("of_source", F.sum("_n").over(Window.partitionBy(*queue))).drop("_n")
    buckets = buckets.withColumn("_of_b", ahead("_n", [*queue, "_g"], "_b")).drop("_n").join(groups, [*queue, "_g"])
    rows = rows.withColumn("_of", ahead("n_tokens", [*queue, "_g", "_b"], "_h", "doc_id"))
    return rows.join(buckets, [*queue, "_g", "_b"]).select(*sized.columns, (F.col("_of_g") + F.col("_of_b") + F.col("_of")).alias("before"), "of_source")


def pack_part(items: pd.DataFrame) -> pd.DataFrame:
    """Pack one part: items (limit_name, part, parts, doc_id, piece_no, size, source, before, of_source, total, max_tokens)."""
    one = items.iloc[0]
    name, part, parts, capacity = one["limit_name"], int(one["part"]), int(one["parts"]), int(one["max_tokens"])
    queues: dict[str, deque] = {}
    share, owed = {}, {}
    for before, doc, k, source, size, whole in sorted(zip(*(items[c].tolist() for c in ("before", "doc_id", "piece_no", "source", "size", "of_source")))):
        if source not in queues:
            queues[source] = deque()
            # the first item starts where the last one of the part before reached to
            share[source], owed[source] = whole / one["total"], whole * (part / parts) - before
        queues[source].append((size, doc, k, source))
    rows = []
    bins = Bins(capacity)
    for w, taken in enumerate(windows(queues, share, owed, float(WINDOW * capacity))):
        for size, doc, k, source in sorted(taken, key=lambda t: (-t[0], t[1], t[2])):
            rows.append((name, (part << 24) | bins.place(size), doc, k, k * capacity, size, source, w))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])


def pack(docs: DataFrame, limits: DataFrame, folder: str = tokens.TOKENIZERS, part: int = PART) -> DataFrame:
    """Where each document comes to lie for each 'pack' row of ``limits``.

    Columns: limit_name, container, doc_id, piece_no, first_token, n_tokens, source, window_no. A document is whole (one row)
    unless it alone exceeds max_tokens; then it has a row for each max_tokens tokens of it. Documents without tokens
    (null, empty) don't come out. A null source counts as an empty one. Repeated rows are items of their own. Target
    proportions are the sources' shares of all tokens. ``limits`` is a fixed configuration table of a few rows. ``part`` is how
    many containers a part has at most; a container's number holds its part's in front of the last 24 bits.
    """
    names = sorted({r["tokenizer"] for r in limits.filter(F.col("purpose") == "pack").collect()})
    return pack_sized(cut(sizes(docs, "doc_id", "text", "source", names, folder).filter(F.col("n_tokens") > 0)), limits, part)


def pack_sized(sized: DataFrame, limits: DataFrame, part: int = PART) -> DataFrame:
    """As pack, from sizes (doc_id, source, tokenizer, n_tokens) that are all positive. They are read several times."""
    spark = sized.sparkSession
    rows = limits.filter(F.col("purpose") == "pack").select("limit_name", "tokenizer", "max_tokens").collect()
    totals = sized.groupBy("tokenizer").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items")).collect()
    total = {r["tokenizer"]: (r["tokens"], r["items"]) for r in totals}
    conf = []
    for r in rows:
        size, count = total.get(r["tokenizer"], (0, 0))
        conf.append((r["limit_name"], r["tokenizer"], r["max_tokens"], max(1, round(size / (part * r["max_tokens"])), -(-count // ITEMS)), size))
    conf = spark.createDataFrame(conf, "limit_name string, tokenizer string, max_tokens int, parts bigint, total bigint")
    items = queued(sized, max([0, *(n for _, n in total.values())])).join(F.broadcast(conf), "tokenizer")
    # only what alone exceeds a container is cut; its full pieces fill containers of their own
    items = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / F.col("max_tokens")).cast("int"))))
    done = F.col("piece_no").cast("bigint") * F.col("max_tokens")
    items = items.withColumn("size", F.least(F.col("max_tokens").cast("bigint"), F.col("n_tokens") - done)).withColumn("before", F.col("before") + done)
    items = items.withColumn("part", F.least(F.col("parts") - 1, F.floor(F.col("before") / F.col("of_source") * F.col("parts"))))
    slim = items.select("limit_name", "part", "parts", "doc_id", "piece_no", "size", "source", "before", "of_source", "total", "max_tokens")
    return slim.groupBy("limit_name", "part").applyInPandas(pack_part, _OUT)


def mixture(packed: DataFrame) -> DataFrame:
    """(limit_name, parts, windows, distance): how far the sources' shares in a window's tokens are from their shares in all.

    The distance is half the sum of the differences, averaged over the windows by their tokens.
    """
    by = packed.groupBy("limit_name", F.shiftright("container", 24).alias("part"), "window_no", "source").agg(F.sum("n_tokens").alias("n"))
    goal = by.groupBy("limit_name", "source").agg(F.sum("n").alias("of_source"))
    goal = goal.withColumn("share", F.col("of_source") / F.sum("of_source").over(Window.partitionBy("limit_name")))
    here = by.join(goal, ["limit_name", "source"]).groupBy("limit_name", "part", "window_no").agg(
        F.sum("n").alias("tokens"), F.sum("share").alias("met"), F.collect_list(F.struct("n", "share")).alias("all")
    )
    apart = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.abs(x["n"] / F.col("tokens") - x["share"])) + F.greatest(F.lit(0.0), 1 - F.col("met"))
    here = here.withColumn("distance", apart / 2)
    return here.groupBy("limit_name").agg(
        F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("windows"), (F.sum(F.col("distance") * F.col("tokens")) / F.sum("tokens")).alias("distance")
    )


def usage(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, containers, tokens, fullest, unused_share): how well the containers are filled."""
    sums = packed.groupBy("limit_name", "container").agg(F.sum("n_tokens").alias("n"))
    out = sums.join(F.broadcast(limits.select("limit_name", "max_tokens")), "limit_name").groupBy("limit_name", "max_tokens")
    return out.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest")).withColumn(
        "unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 6)
    ).drop("max_tokens")
