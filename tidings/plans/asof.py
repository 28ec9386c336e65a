"""As-of lookup: for each probe the last fact before it, without pairing probes and facts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.plans.scan import segmented_scan

DAY = 86_400


def last_before(
    probes: DataFrame,
    facts: DataFrame,
    on: Sequence[str],
    probe_time: str,
    fact_time: str,
    payload: str,
    name: str = "found",
    *,
    reverse: bool = False,
    inclusive: bool = False,
) -> DataFrame:
    """Add to each probe the payload of the last fact of its key that is earlier than it.

    ``reverse`` looks for the first later fact instead, ``inclusive`` admits equal times. Of
    several facts at one time the one with the smallest payload wins; probes without a hit
    get null, and so do probes with a null in their key or no time: null keys match nothing. Probes and
    facts are merged into one time line per key, and the last fact is carried along it, so the
    work is linear in their sum, and a hot key is as many pieces as its share of the rows calls for.
    """
    on = list(on)
    sign = -1 if reverse else 1
    tick = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * sign
    # a probe sorts before facts of its own time unless equal times count
    probe_rank, fact_rank = (1, 0) if inclusive else (0, 1)
    p = probes.select(
        *on, tick(probe_time).alias("_t"), F.lit(probe_rank).alias("_rank"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("_probe"),
    )
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on], F.col(fact_time).isNotNull())
    f = facts.where(known).select(
        *on, tick(fact_time).alias("_t"), F.lit(fact_rank).alias("_rank"), F.col(payload).alias("_payload")
    )
    line = p.unionByName(f, allowMissingColumns=True)
    scanned = segmented_scan(line, on, ["_t", "_rank", F.col("_payload").desc()], last={"_hit": F.col("_payload")})
    return scanned.where(F.col("_probe").isNotNull()).select("_probe.*", F.col("_hit").alias(name))
