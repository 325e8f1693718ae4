"""Small expressions over text, numbers and tag maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# The keys of names in a language, and the same pattern with the region digits
# unreachable, as existing language tables were built.
LANGUAGE_KEY = (
    r"^name:[a-z]{2,3}(-[A-Z][a-z]{3})?((-[a-z]{2,}|x-[a-z]{2,})(-[a-z]{2,})?)?(-([A-Z]{2}|\d{3}))?$"
)
LANGUAGE_KEY_STRICT = LANGUAGE_KEY.replace(r"\d{3}", r"\\d{3}")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    Keeps the expression tree small: nested plain expressions would be copied
    at every use.
    """
    return F.get(F.transform(F.array(value), body), 0)


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def first_present(*values: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[empty_to_null(v) for v in values])


def override(relation: Column, way: Column) -> Column:
    """The relation's text where it has one, else the way's."""
    return F.coalesce(empty_to_null(relation), way)


def differs(value: Column, other: Column) -> Column:
    """A present value that is not the other value."""
    return empty_to_null(value).isNotNull() & ~value.eqNullSafe(other)


def construction_type(highway: Column, tags: Column, otherwise: Column) -> Column:
    """Roads under construction carry the planned class in their type."""
    planned = empty_to_null(tag(tags, "construction"))
    return F.when(
        highway == "construction",
        F.coalesce(F.concat(planned, F.lit("_construction")), F.lit("road_construction")),
    ).otherwise(otherwise)


def joined_id(left: Column, right: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (left, right)]
    return F.concat(parts[0], F.lit("_"), parts[1])


def as_numeric(text: Column) -> Column:
    """Number in the text, -1 when it is not one, NULL on NULL."""
    return F.when(text.isNotNull(), F.coalesce(text.try_cast("double"), F.lit(-1.0)))


def digits_and_dot(text: Column) -> Column:
    """Number left after dropping all but digits and dots."""
    return empty_to_null(F.regexp_replace(text, "[^0-9.]", "")).try_cast("double")


def digits_to_int(text: Column, default: int = 999999) -> Column:
    """All digits of the text as one integer, or the default."""
    return F.coalesce(F.regexp_replace(text, r"\D", "").try_cast("int"), F.lit(default))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def trimmed_upper(text: Column) -> Column:
    return F.trim(F.upper(F.coalesce(text, F.lit(""))))


def language_key(key: Column, strict_reference: bool = False) -> Column:
    """Is this tag key a language-specific name?"""
    return key.rlike(LANGUAGE_KEY_STRICT if strict_reference else LANGUAGE_KEY)


def key_alias(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, r"[:\-]", "_"))


def language_column_name(key: str) -> str:
    """``name:ar-Latn`` becomes ``name_ar_latn``."""
    suffix = key[len("name:"):].lower()
    return "name_" + "".join(c if c.isascii() and c.isalnum() else "_" for c in suffix)


def language_columns(keys: Sequence[str], tags: Column) -> list[Column]:
    """One column per language key, then the two fixed name variants."""
    columns = [tag(tags, k).alias(language_column_name(k)) for k in keys]
    return columns + [tag(tags, k).alias(k) for k in ("short_name", "official_name")]


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def merge_tags(left: Column, right: Column) -> Column:
    """Union of two maps; the right side wins on a common key."""
    kept = F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.map_concat(kept, right)


def drop_tags(tags: Column, patterns: Sequence[str]) -> Column:
    """Remove keys that equal a pattern, or start with one that ends in ``*``."""
    exact = [p for p in patterns if not p.endswith("*")]
    prefixes = [p[:-1] for p in patterns if p.endswith("*")]

    def keep(key: Column, _: Column) -> Column:
        drop = key.isin(exact) if exact else F.lit(False)
        for prefix in prefixes:
            drop = drop | key.startswith(prefix)
        return ~drop

    return F.map_filter(tags, keep)


def sequence_path(sequence: Column, suffix: str = ".osc.gz") -> Column:
    """Sequence number as the path ``AAA/BBB/CCC`` of its diff file."""
    digits = F.lpad(sequence.cast("string"), 9, "0")
    parts = [F.substring(digits, start, 3) for start in (1, 4, 7)]
    return F.concat(F.concat_ws("/", *parts), F.lit(suffix))


def human_duration(seconds: Column) -> Column:
    """Seconds as ``Ns``, ``Nm``, ``Nh Nm`` or ``Nd Nh`` ago."""
    whole = seconds.cast("long")
    minutes = F.floor(whole / 60)
    hours = F.floor(whole / 3600)
    days = F.floor(whole / 86400)

    def text(value: Column, unit: str) -> Column:
        return F.concat(value.cast("string"), F.lit(unit))

    def pair(major: Column, unit: str, minor: Column, minor_unit: str) -> Column:
        return F.when(
            minor > 0, F.concat(text(major, unit), F.lit(" "), text(minor, minor_unit))
        ).otherwise(text(major, unit))

    body = (
        F.when(whole < 60, text(whole, "s"))
        .when(minutes < 60, text(minutes, "m"))
        .when(hours < 24, pair(hours, "h", minutes % 60, "m"))
        .otherwise(pair(days, "d", hours % 24, "h"))
    )
    return F.concat(body, F.lit(" ago"))


def rounded_decimal(value: Column, places: int = 1) -> Column:
    """Half-up rounding on decimals, as decimal(20, places)."""
    return F.round(value.cast("decimal(30,10)"), places).cast(f"decimal(20,{places})")


def half_even_long(value: Column) -> Column:
    """A double rounded half to even, as a long."""
    return F.bround(value, 0).cast("long")
