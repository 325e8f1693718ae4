"""Route ranking score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrachron.functions.text import count_char, digits_to_int

# Base score by route type.
BASE_SCORE = {
    "road": 1_000_000_000_000,
    "train": 900_000_000_000,
    "subway": 850_000_000_000,
    "light_rail": 800_000_000_000,
    "tram": 750_000_000_000,
    "trolleybus": 700_000_000_000,
    "bus": 650_000_000_000,
}
OTHER_SCORE = 100_000_000_000

# Bonus by network, the first match counts.
NETWORK_BONUS = [
    (r"^US:I$", 1_000_000),
    (r"^US:US$", 900_000),
    (r"^US:[A-Z]{2}$", 800_000),
    (r"^US:[A-Z]{2}:.+", 700_000),
    (r":national$", 700_000),
    (r":regional$", 600_000),
]

ROUTE_TYPES = list(BASE_SCORE)
SLOTS = 6
SLOT_ATTRIBUTES = ["ref", "network", "network_wikidata", "operator", "name", "direction"]


def route_priority(kind: Column, network: Column, ref: Column) -> Column:
    """Larger is more important: type first, then network, then a small ref."""
    base = F.lit(OTHER_SCORE)
    for name, score in reversed(BASE_SCORE.items()):
        base = F.when(kind == name, F.lit(score)).otherwise(base)
    bonus = F.lit(0)
    for pattern, points in reversed(NETWORK_BONUS):
        bonus = F.when(network.rlike(pattern), F.lit(points)).otherwise(bonus)
    text = F.coalesce(network, F.lit(""))
    depth = (F.lit(100) - count_char(text, ":")).cast("long") * F.lit(1_000_000_000)
    road = depth + (F.lit(1_000_000) - digits_to_int(ref))
    other = F.lit(1000) - F.length(text)
    return (base + bonus + F.when(kind == "road", road).otherwise(other)).cast("decimal(20,0)")


def slot_columns(kind: str, count: int = SLOTS) -> list[str]:
    """Names of the slot columns of one route type."""
    return [f"route_{kind}_{i}_{a}" for i in range(1, count + 1) for a in SLOT_ATTRIBUTES]
