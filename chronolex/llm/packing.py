"""Filling fixed-capacity containers with documents, source mixture controlled (problem 8).

Method: mixture-controlled packing.  Every source is a queue in a seeded random order.
Deficit round-robin serves the queues in windows of ``window_containers`` containers:
a window gives every queue that is not empty a quantum of tokens in proportion to its
target share, a queue sends documents while its saved-up quanta cover the next one, and
what is left (the deficit) is carried into the next window.  A document therefore leaves
at the turn v at which share * v reaches the running total of its queue; by then all
queues together have sent sum(min(tokens of a queue, its share * v)), and that sum over
the tokens of a window is its window.  So the window of every document follows from
distributed prefix sums over (source, bucket), deficits run on across windows, buckets
and partitions, no queue is walked by one task, and when a queue ends the others fill
the windows.  Inside a window the documents are packed best-fit decreasing.

A document larger than the capacity is divided into full containers and one rest, and
only the rest is packed with others.  No other document is divided.

Defined results: a null or empty text has no tokens and takes no place; a null source
is a queue of its own; equal texts are separate items; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.bpe import DEFAULT_TOKENIZER, count_tokens
from chronolex.runtime import written

CAPACITY = 2048
#: Containers filled together; about half a million tokens at the default capacity.
WINDOW_CONTAINERS = 256
#: Documents of one source that a task sorts; a larger queue is cut into buckets.
BUCKET_ROWS = 50_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container, from 0, of every item; each size is at most ``capacity``."""
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    place = [0] * len(sizes)
    opened = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            left, c = room.pop(k)
        else:
            left, c = capacity, opened
            opened += 1
        place[i] = c
        if left > sizes[i]:
            insort(room, (left - sizes[i], c))
    return place


def pack_items(items: DataFrame, *, capacity: int = CAPACITY, window_containers: int = WINDOW_CONTAINERS, shares: dict[str, float] | None = None, seed: int = 17) -> DataFrame:
    """Packs ``items(key, source, tokens)``; ``items`` is read more than once.

    Returns ``(key, source, piece, first_token, tokens, divided, window, slot)``: the piece
    of a document, where in it the piece begins, and its container (``window``, ``slot``).
    Full pieces of divided documents have a container of their own: window -1 and the
    slot a hash of document and piece.  ``shares`` gives target shares by source, of which
    the driver learns the totals; sources without one are spread over all windows.  By
    default a source's share is its share of all tokens.
    """
    items = items.where(F.col("tokens") > 0)
    cap = F.lit(capacity)
    full = F.floor(F.col("tokens") / cap).cast("int")
    own = (
        items.where(F.col("tokens") > cap)
        .select("key", "source", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
        .select("key", "source", "piece", (F.col("piece") * cap).alias("first_token"), cap.cast("int").alias("tokens"), F.lit(True).alias("divided"), F.lit(-1).cast("long").alias("window"), F.xxhash64("key", "piece").alias("slot"))
    )
    part = items.select(
        "key", "source", (F.col("tokens") > cap).alias("divided"),
        F.when(F.col("tokens") > cap, F.col("tokens") % cap).otherwise(F.col("tokens")).alias("tokens"),
        F.when(F.col("tokens") > cap, full).otherwise(F.lit(0)).alias("piece"),
        F.xxhash64("key", F.lit(seed)).alias("h"),
    ).where(F.col("tokens") > 0)

    queue = part.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    whole = queue.agg(F.sum("t").alias("all_t"))
    own_share = F.col("t") / F.col("all_t")
    wanted = {k: v for k, v in (shares or {}).items() if v > 0}
    if wanted:
        target = F.element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.coalesce("source", F.lit("")))
        totals = {r["source"]: float(r["t"]) for r in queue.where(F.col("source").isin(*wanted)).collect()}  # one line for each share given
        rest = float((queue.agg(F.sum("t")).first()[0] or 0) - sum(totals.values()))
        last = max((t / wanted[k] for k, t in totals.items()), default=1.0)  # the turn at which all are sent
        share = F.coalesce(target, F.col("t") / last)
        sent = sum((F.least(F.lit(t), F.lit(wanted[k]) * F.col("turn")) for k, t in totals.items()), F.least(F.lit(rest), F.lit(rest / last) * F.col("turn")))
    else:
        share, sent = own_share, F.col("turn")
    pace = queue.crossJoin(whole).select("source", share.alias("share"), F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    placed = part.alias("p").join(pace.alias("q"), F.col("p.source").eqNullSafe(F.col("q.source"))).select("p.*", "share", F.pmod(F.shiftright("h", 20), F.col("buckets")).alias("bucket"))
    before = (
        placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
        .select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("before"))
    )
    line = Window.partitionBy("source", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("run", F.sum("tokens").over(line))
    total = run.alias("r").join(before.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket"))).select("r.*", (F.col("run") + F.col("before")).alias("total"))
    turns = total.withColumn("turn", F.col("total") / F.col("share"))
    window = F.greatest(F.ceil(F.round(sent / (window_containers * capacity), 9)) - 1, F.lit(0)).cast("long")
    windows = turns.select("key", "source", "piece", (F.col("piece") * cap).alias("first_token"), F.col("tokens").cast("int").alias("tokens"), "divided", window.alias("window"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "key"], ascending=[False, True], kind="stable")
        return pdf.assign(slot=best_fit_decreasing(pdf["tokens"].tolist(), capacity))

    packed = windows.groupBy("window").applyInPandas(fill, own.schema)
    return own.unionByName(packed)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, tokenizer: str = DEFAULT_TOKENIZER, **options) -> DataFrame:
    """Counts the tokens of every document once and packs the documents."""
    counts = count_tokens(df.select(F.struct(F.col(key).alias("key"), F.col(source).alias("source")).alias("item"), F.col(text).alias("text")), "item", "text", tokenizer=tokenizer)
    return pack_items(written(counts.select("item.key", "item.source", "tokens")), **options)


def containers(placements: DataFrame) -> DataFrame:
    """``(window, slot, items, tokens)`` of each container."""
    return placements.groupBy("window", "slot").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


def report(placements: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, share of the space filled, documents divided."""
    return containers(placements).agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * capacity)).alias("filled"))


def mixture(placements: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(window, source, tokens, share, target, deviation)`` of each window of mixed containers.

    The target is the source's share among those of ``shares`` that the window holds;
    sources without a share have none and are left out of the others' shares.
    """
    target = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.coalesce("source", F.lit("")))
    rows = placements.where("window >= 0").groupBy("window", "source").agg(F.sum("tokens").alias("tokens")).withColumn("wanted", target)
    among = Window.partitionBy("window")
    share = F.when(F.col("wanted").isNotNull(), F.col("tokens") / F.sum(F.when(F.col("wanted").isNotNull(), F.col("tokens"))).over(among))
    aim = F.col("wanted") / F.sum("wanted").over(among)
    return rows.select("window", "source", "tokens", F.round(share, 6).alias("share"), F.round(aim, 6).alias("target"), F.round(share - aim, 6).alias("deviation"))


def divided(placements: DataFrame) -> DataFrame:
    """The documents that lie in more than one container."""
    return placements.where("divided").select("key").distinct()
