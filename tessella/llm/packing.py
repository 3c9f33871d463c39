"""Problem 7: packing items of varying length into containers of fixed capacity.

Variable-capacity best fit: several container sizes are permitted; items come
in decreasing order and go to the open container with the least sufficient
room; if none has room, every permitted size is tried on the histogram of the
items still to come, and the one that they fill at the least cost per token is
opened; at the end every container is reduced to the smallest permitted size
that holds its contents.  The mix of sizes so found is compared with those of
less choice, down to one size for all, and the cheapest is taken.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Permitted container sizes as shares of the capacity.
SHARES = (1.0, 0.75, 0.5, 0.25)
#: Cost of a container besides its size, as a share of the capacity.
OVERHEAD = 0.02
MOST_SPECS = 10_000


def permitted_sizes(capacity: int, shares: tuple[float, ...] = SHARES) -> list[int]:
    return sorted({max(1, math.ceil(capacity * s)) for s in shares} | {capacity})


def _filled(size: int, first: int, left: dict[int, int], present: int) -> int:
    """How full a container gets: `first`, then always the largest item to come that fits, by the histogram `left` and the bits of its sizes."""
    room, used = size - first, {}
    while room and (fits := present & ((2 << room) - 1)):
        s = fits.bit_length() - 1
        if not s:
            break
        n = min(room // s, left[s] - used.get(s, 0))
        if n:
            used[s] = used.get(s, 0) + n
            room -= s * n
        present &= ~(1 << s)
    return size - room


def placed(sizes: list[int], capacity: int, permitted: list[int], overhead: float = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Best fit with the permitted sizes: the container of each item, the size each container is opened with, and its room in the end."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left: dict[int, int] = {}
    for s in sizes:
        left[s] = left.get(s, 0) + 1
    present = sum(1 << s for s in left)
    extra = overhead * capacity
    room: list[int] = []
    opened: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r set: some container has room r
    where = [0] * len(sizes)
    for i in order:
        s = sizes[i]
        left[s] -= 1
        if not left[s]:
            present &= ~(1 << s)
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                free &= ~(1 << r)
        else:
            k = len(opened)
            fitting = [c for c in permitted if c >= s]
            choice = fitting[0] if len(fitting) == 1 else min(fitting, key=lambda c: ((c + extra) / max(1, _filled(c, s, left, present)), -c))
            opened.append(choice)
            room.append(choice)
            r = choice
        where[i] = k
        room[k] = r - s
        by_room[r - s].append(k)
        free |= 1 << (r - s)
    return where, opened, room


def best_fit(sizes: list[int], capacity: int, shares: tuple[float, ...] = SHARES, overhead: float = OVERHEAD) -> tuple[list[int], list[int]]:
    """The container of each item and the size of each container.

    Items must not exceed `capacity`.  Items of size 0 go to the first
    container (one is opened if there is none).  Ties: earlier items first,
    larger containers first, more sizes first.
    """
    permitted = permitted_sizes(capacity, shares)
    best: tuple[float, list[int], list[int]] | None = None
    least = 0
    while least <= capacity:  # all sizes, then without the smallest that was opened, at last the capacity alone
        where, opened, room = placed(sizes, capacity, [c for c in permitted if c >= least], overhead)
        final = [permitted[bisect_left(permitted, c - r)] for c, r in zip(opened, room)]
        cost = sum(final) + overhead * capacity * len(final)
        if best is None or cost < best[0] - 1e-9:
            best = cost, where, final
        least = min(opened, default=capacity) + 1
    return best[1:]


def packed(spark: SparkSession, items: DataFrame, specs: DataFrame, key: str = "doc_id", tokenizer: str = "tokenizer", size: str = "tokens", block_rows: int = 20_000, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Containers for every spec: `spec_id`, `key`, `piece`, `start`, `tokens`, `container`, `container_size`, `capacity`.

    `items` holds `key`, `tokenizer` and `tokens`; `specs` holds `spec_id`, `tokenizer`, `capacity`.
    Items are dealt into blocks of about `block_rows` by the hash of their
    position, and each block is packed by itself: a block wastes at most one
    partly filled container more than one packing of all items would.  An item
    larger than the capacity is cut into whole containers and a last piece;
    all others stay whole.  Items of no tokens are placed, at no room.  Null
    sizes count as 0; specs with a null or non-positive capacity give no rows;
    an empty table gives none.  Container names are unique within a spec.
    """
    i = items.select(F.col(key).alias("_k"), F.col(tokenizer).alias("_t"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"), F.monotonically_increasing_id().alias("_at"))
    blocks = max(1, math.ceil(items.count() / block_rows))
    i = i.withColumn("_block", F.pmod(F.xxhash64("_at"), F.lit(blocks)))
    s = specs.where("capacity > 0").select("spec_id", F.col("tokenizer").alias("_t"), F.col("capacity").cast("int"))
    # few specs, counted before they are sent everywhere; their join key has so few values that a shuffle would pile up
    if s.count() > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs; pack them in several calls")
    both = i.join(F.broadcast(s), "_t")
    kind = items.schema[key].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, spec, block = int(pdf["capacity"].iloc[0]), pdf["spec_id"].iloc[0], pdf["_block"].iloc[0]
        pdf = pdf.sort_values("_at")
        keys, pieces, starts, sizes = [], [], [], []
        for k, n in zip(pdf["_k"].tolist(), pdf["_n"].tolist()):
            for piece, at in enumerate(range(0, max(n, 1), capacity)):
                keys.append(k)
                pieces.append(piece)
                starts.append(at)
                sizes.append(min(capacity, n - at))
        where, final = best_fit(sizes, capacity, shares)
        return pd.DataFrame({"spec_id": spec, key: keys, "piece": pieces, "start": starts, "tokens": sizes, "container": [f"{block}-{w}" for w in where], "container_size": [final[w] for w in where], "capacity": capacity})

    return both.groupBy("spec_id", "_block").applyInPandas(pack, f"spec_id int, {key} {kind}, piece int, start long, tokens int, container string, container_size int, capacity int")


def fill(packing: DataFrame, single: DataFrame | None = None, overhead: float = OVERHEAD) -> DataFrame:
    """Per spec: containers, tokens, room of the containers as opened, the share of it that is used, and the cost (room and the overhead of each container).

    With `single`, the packing of the same items into containers of the
    capacity only, also the cost of that, and how many sizes this one uses.
    """

    def per_spec(p: DataFrame) -> DataFrame:
        per = p.groupBy("spec_id", "capacity", "container").agg(F.sum("tokens").alias("t"), F.max("container_size").alias("c"))
        return per.groupBy("spec_id", "capacity").agg(
            F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.sum(F.col("c").cast("long")).alias("room"), F.round(F.sum("t") / F.sum("c"), 6).alias("used"),
            F.round(F.sum("c") + overhead * F.col("capacity") * F.count(F.lit(1)), 2).alias("cost"), F.countDistinct("c").alias("sizes"),
        )

    out = per_spec(packing)
    if single is None:
        return out
    return out.join(per_spec(single).select("spec_id", F.col("cost").alias("single_cost")), "spec_id")
