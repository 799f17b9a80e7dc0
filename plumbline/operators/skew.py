"""Joining facts about keys back to rows when a key may have a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that count as crowded: more rows than this, and than a thousandth of all; bytes of their facts that are broadcast.
CROWDED, HOT_BYTES = 1_000, 32 << 20


def joined(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, size: Column | None = None) -> DataFrame:
    """``rows`` inner-joined with ``facts``, one row per key, of which ``n`` says how many rows the key has.

    The facts of crowded keys (at most 1,000 of them) are broadcast and those keys' rows stay where they
    are; all others meet in a shuffle. ``size``: bytes of a fact (64 where it is not given); where the
    crowded keys' facts have more than ``HOT_BYTES``, fewer of them count as crowded.
    """
    width = F.coalesce(size, F.lit(0)) + 64 if size is not None else F.lit(64)
    total, most = facts.agg(F.sum(n), F.max(n)).first()
    least = max(CROWDED, (total or 0) // 1_000)
    while (most or 0) > least and (facts.filter(F.col(n) > least).agg(F.sum(width)).first()[0] or 0) > HOT_BYTES:
        least *= 4
    if (most or 0) <= least:
        return rows.join(facts, keys)
    hot = F.broadcast(facts.filter(F.col(n) > least))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(facts.filter(F.col(n) <= least), keys)
    return cold.unionByName(rows.join(hot, keys))
