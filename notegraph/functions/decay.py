"""Read-time decay of edge weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegraph.settings import DEFAULT, Settings


def rate(tag: Column, s: Settings = DEFAULT) -> Column:
    out = F.lit(s.lambdas["default"])
    for name in ("ephemeral", "decree"):
        out = F.when(tag == name, F.lit(s.lambdas[name])).otherwise(out)
    return out


def effective(weight: Column, tag: Column, last_touch: Column, s: Settings = DEFAULT) -> Column:
    """weight * exp(-rate * age); an edge never touched, or of rate zero, does not decay."""
    touched = F.when(last_touch != 0, last_touch)
    aged = weight * F.exp(-rate(tag, s) * F.greatest(F.lit(0.0), F.lit(s.now) - touched))
    return F.when(touched.isNull() | (rate(tag, s) == 0), weight).otherwise(aged)


def alive(effective_weight: Column, s: Settings = DEFAULT) -> Column:
    return effective_weight >= s.dead_below


def may_be_alive(tag: Column, last_touch: Column, max_weight: float, s: Settings = DEFAULT) -> Column:
    """A bound on last_touch that every live edge keeps; unlike the decay itself it reaches the scan."""
    keep = last_touch.isNull() | (last_touch == 0) | (tag == "decree")
    for name in ("ephemeral", "default"):
        reach = math.log(max(max_weight / s.dead_below, 1.0)) / s.lambdas[name]
        other = ~tag.isin("ephemeral", "decree") | tag.isNull() if name == "default" else tag == name
        keep = keep | (other & (last_touch >= s.now - reach - 1.0))
    return keep


def tag_of(tags: Column, stored: Column | None = None) -> Column:
    """Decree before ephemeral before default, over both ends' tags; a stored tag wins."""
    derived = F.when(F.array_contains(tags, "decree"), "decree").when(F.array_contains(tags, "ephemeral"), "ephemeral").otherwise("default")
    return derived if stored is None else F.coalesce(F.when(stored != "", stored), derived)
