"""Tag mapping: which layers an element belongs to, and why it belongs to none."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrachron.functions.geometry import area, broken_way
from terrachron.functions.text import bind, drop_tags, empty_to_null, tag
from terrachron.operators.skew import attach
from terrachron.sources.layers import (
    ANY,
    DATES,
    ELEMENT_TYPES,
    EXCLUDED_TAGS,
    LAYERS,
    RELATION_TYPES,
    drawing_order,
    typed_value,
)

RULE_SCHEMA = (
    "layer string, shape string, tag_key string, accepted array<string>, "
    "excluded array<string>, reject map<string,array<string>>, element_types array<string>"
)


def rule_rows(layers: Iterable[str] | None = None) -> list[tuple]:
    """One row per layer and mapped key; unknown layer names are skipped."""
    chosen = LAYERS if layers is None else [n for n in LAYERS if n in set(layers)]
    rows = []
    for name in chosen:
        layer = LAYERS[name]
        for key, accepted in layer.mapping.items():
            rows.append(
                (
                    name,
                    layer.geometry,
                    key,
                    accepted,
                    layer.exclude.get(key, []),
                    layer.reject,
                    ELEMENT_TYPES[layer.geometry],
                )
            )
    return rows


def rule_table(spark: SparkSession, layers: Iterable[str] | None = None) -> DataFrame:
    """The mapping rules as a table; its size is fixed by the layer list."""
    return spark.createDataFrame(rule_rows(layers), RULE_SCHEMA)


def _rejected(tags: Column, reject: Column) -> Column:
    """Does any reject filter of a rule match the tags?"""

    def matches(entry: Column) -> Column:
        value = F.try_element_at(tags, entry["key"])
        wild = F.array_contains(entry["value"], F.lit(ANY)) & value.isNotNull()
        return F.coalesce(wild | F.array_contains(entry["value"], value), F.lit(False))

    return F.exists(F.map_entries(reject), matches)


def map_elements(
    elements: DataFrame, layers: Iterable[str] | None = None, by_type: bool = True
) -> DataFrame:
    """Elements with the layers that take them; an element may come out several times.

    Adds ``layer`` and its ``shape``, ``class`` (the matched key) and ``type_value``
    (its value).
    """
    rows = rule_rows(layers)
    if not rows:
        none = {c: F.lit(None).cast("string") for c in ("class", "type_value", "layer", "shape")}
        return elements.withColumns(none).limit(0)
    rules, by_key = rule_literals(rows)
    tags = F.col("tags")

    def fits(rule: Column) -> Column:
        value = F.try_element_at(tags, rule["key"])
        kept = F.array_contains(rule["accepted"], F.lit(ANY)) | F.array_contains(rule["accepted"], value)
        kept = kept & ~F.array_contains(rule["excluded"], value)
        if by_type:
            kept = kept & F.array_contains(rule["types"], F.col("type"))
        return kept & ~_rejected(tags, rule["reject"])

    def match(rule: Column) -> Column:
        value = F.try_element_at(tags, rule["key"])
        return F.struct(rule["key"], value, rule["layer"], rule["geometry"])

    # Only matches are exploded, so an element is copied once for each layer that takes it.
    found = F.transform(F.filter(rules_of(tags, rules, by_key), fits), match)
    exploded = elements.select("*", F.inline(found).alias("class", "type_value", "layer", "shape"))
    return exploded


def rule_literals(rows: list[tuple], coastline: bool = False) -> tuple[Column, Column]:
    """The rules as an array, and the numbers of the rules of each tag key as a map; both are constants."""
    rules = F.array(
        *[
            F.struct(
                F.lit(layer).alias("layer"),
                F.lit(geometry).alias("geometry"),
                F.lit(key).alias("key"),
                F.array(*[F.lit(v) for v in accepted]).alias("accepted"),
                F.array(*[F.lit(v) for v in excluded]).cast("array<string>").alias("excluded"),
                _literal_map(_reject_with_coastline(layer, reject) if coastline else reject).alias("reject"),
                F.array(*[F.lit(t) for t in types]).alias("types"),
            )
            for layer, geometry, key, accepted, excluded, reject, types in rows
        ]
    )
    numbers: dict[str, list[int]] = {}
    for number, row in enumerate(rows):
        numbers.setdefault(row[2], []).append(number)
    pairs = [F.struct(F.lit(k), F.array(*[F.lit(n) for n in ns])) for k, ns in numbers.items()]
    return rules, F.map_from_entries(F.array(*pairs))


def rules_of(tags: Column, rules: Column, by_key: Column) -> Column:
    """The rules of the keys an element has, in the order of the rules."""
    numbers = F.transform(F.map_keys(tags), lambda k: F.coalesce(F.try_element_at(by_key, k), F.array().cast("array<int>")))
    return F.transform(F.array_sort(F.flatten(numbers)), lambda n: F.get(rules, n))


def load_layers(elements: DataFrame, path: str, layers: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The typed tables of all layers from one scan of the elements.

    Matches are written once, in one folder for each layer; every table then reads its
    own folder only.
    """
    chosen = [n for n in LAYERS if layers is None or n in set(layers)]
    mapped = map_elements(elements, chosen)
    mapped.write.mode("overwrite").partitionBy("layer").parquet(path)
    stored = elements.sparkSession.read.schema(mapped.schema).parquet(path)
    return {name: typed_layer(stored.filter(F.col("layer") == name), name) for name in chosen}


def layer_table(elements: DataFrame, name: str) -> DataFrame:
    """The typed table of one layer from raw elements with a geometry.

    ``elements`` has type, osm_id, tags and geometry; a relation-member layer
    also has member, role and me_tags.
    """
    return typed_layer(map_elements(elements, [name]), name)


def typed_layer(rows: DataFrame, name: str) -> DataFrame:
    """The typed columns of a layer from its mapped elements."""
    layer = LAYERS[name]
    tags = F.col("tags")
    sign = F.when(F.col("type") == "relation", -F.abs("osm_id")).otherwise(F.col("osm_id"))
    columns = [
        F.xxhash64("osm_id", "class", *(["member"] if layer.geometry == "relation_member" else [])).alias("id"),
        sign.alias("osm_id"),
        F.col("geometry"),
        tag(tags, "name").alias("name"),
        F.col("type_value").alias("type"),
        F.col("class"),
        *[tag(tags, c).alias(c) for c in DATES],
        *[tag(tags, key).alias(column) for column, key in layer.text.items()],
    ]
    for column, kind in layer.typed.items():
        if kind == "area":
            value = area(F.col("geometry"))
        elif kind == "wayzorder":
            value = drawing_order(tags)
        else:
            value = typed_value(tags, column, kind)
        columns.append(value.alias(column))
    columns.append(drop_tags(tags, EXCLUDED_TAGS).alias("tags"))
    if layer.geometry == "relation_member":
        columns += [F.col("member"), F.col("role"), drop_tags(F.col("me_tags"), EXCLUDED_TAGS).alias("me_tags")]
        columns += [tag(F.col("me_tags"), key).alias(c) for c, key in layer.member.items()]
    return rows.select(*columns).filter(F.col("geometry").isNotNull())


def relation_members(relations: DataFrame, members: DataFrame) -> DataFrame:
    """One row per relation and member, with the tags and geometry of the member.

    ``relations`` has ``members array<struct<type,ref,role>>``; ``members`` has
    type, osm_id, tags and geometry.
    """
    rows = relations.withColumn("_m", F.explode("members")).drop("members", "geometry")
    rows = rows.select(
        "*",
        F.col("_m.type").alias("member_type"),
        F.col("_m.ref").alias("member"),
        F.col("_m.role").alias("role"),
    ).drop("_m")
    parts = members.select(
        F.col("type").alias("member_type"),
        F.col("osm_id").alias("member"),
        F.col("tags").alias("me_tags"),
        "geometry",
    )
    return attach(rows, parts, ["member_type", "member"])


def candidate_layers(elements: DataFrame) -> DataFrame:
    """Layers an element should be in, by tags and by point or non-point shape.

    Nodes go to point layers only, ways and relations to all others; a coastline
    goes nowhere. ``layers`` is sorted.
    """
    by_key: dict[str, list[str]] = {}
    for name, layer in LAYERS.items():
        for key, accepted in layer.mapping.items():
            by_key.setdefault("type=street" if key == "type" else key, []).append(name)
    points = {k: [n for n in v if n.endswith("_points")] for k, v in by_key.items()}
    others = {k: [n for n in v if not n.endswith("_points")] for k, v in by_key.items()}

    # A key counts with all its layers as soon as one of them fits the element.
    def table(fitting: dict[str, list[str]]) -> Column:
        entries = [(k, by_key[k]) for k, v in fitting.items() if v]
        pairs = [F.struct(F.lit(k), F.array(*[F.lit(n) for n in v])) for k, v in entries]
        return F.map_from_entries(F.array(*pairs))

    tags = F.col("tags")
    usable = F.map_filter(tags, lambda k, v: ~((k == "natural") & (v == "coastline")))
    keys = F.transform(
        F.map_entries(usable),
        lambda e: F.when(e["key"] == "type", F.concat(F.lit("type="), e["value"])).otherwise(e["key"]),
    )

    def found(lookup: Column) -> Column:
        hits = F.transform(keys, lambda k: F.coalesce(F.try_element_at(lookup, k), F.array()))
        return F.array_sort(F.array_distinct(F.flatten(hits)))

    layers = F.when(F.col("type") == "node", found(table(points))).otherwise(found(table(others)))
    return elements.withColumn("layers", layers)


def skip_reasons(elements: DataFrame) -> DataFrame:
    """Adds ``skip_reason`` (NULL when some layer takes the element) and ``commentable``.

    The first rule that applies counts: no tags, no members, relation type, node
    count, then the reasons of every layer that maps one of the tags. All of it
    is evaluated inside the row; no shuffle is needed.
    """
    tags, kind = F.col("tags"), F.col("type")
    rules, by_key = rule_literals(rule_rows(), coastline=True)

    def matched(rule: Column) -> Column:
        value = F.try_element_at(tags, rule["key"])
        street = (rule["key"] != "type") | F.array_contains(rule["accepted"], value)
        return value.isNotNull() & F.coalesce(street, F.lit(False))

    def reason(rule: Column) -> Column:
        value = F.try_element_at(tags, rule["key"])
        hit = F.get(
            F.filter(
                F.map_entries(rule["reject"]),
                lambda e: F.coalesce(
                    F.array_contains(e["value"], F.try_element_at(tags, e["key"])), F.lit(False)
                ),
            ),
            0,
        )
        label = F.concat(rule["layer"], F.lit(": "))
        pair = F.concat(rule["key"], F.lit("="), value)
        wrong_value = ~F.array_contains(rule["accepted"], F.lit(ANY)) & ~F.array_contains(
            rule["accepted"], value
        )
        return (
            F.when(
                ~F.array_contains(rule["types"], kind),
                F.concat(
                    rule["layer"], F.lit(" requires "), rule["geometry"],
                    F.lit(" geometry (not compatible with "), kind, F.lit(")"),
                ),
            )
            .when(
                (rule["key"] != "type") & hit.isNotNull(),
                F.concat(
                    label, F.lit("rejected because "), hit["key"], F.lit("="),
                    F.try_element_at(tags, hit["key"]),
                ),
            )
            .when(
                (rule["key"] != "type") & wrong_value,
                F.concat(label, pair, F.lit(" is not an accepted value")),
            )
            .when(
                F.array_contains(rule["excluded"], value),
                F.concat(label, pair, F.lit(" is excluded")),
            )
            .otherwise(F.lit(""))
        )

    reasons = F.transform(F.filter(rules_of(tags, rules, by_key), matched), reason)
    relation_type = empty_to_null(tag(tags, "type"))
    nodes = F.col("node_count")
    broken = F.coalesce(broken_way(kind, tag(tags, "area"), nodes), F.lit(False))
    is_area = F.coalesce(tag(tags, "area") == "yes", F.lit(False))

    def decide(reasons: Column) -> Column:
        """The first case that applies: text, and whether the mapper should hear of it."""
        cases = [
            (tags.isNull() | (F.size(tags) == 0), F.lit("Element has no tags"), False),
            ((kind == "relation") & (F.col("member_count") == 0), F.lit("Relation has no members"), False),
            (
                (kind == "relation") & relation_type.isNotNull() & ~relation_type.isin(RELATION_TYPES),
                F.concat(F.lit("Relation type '"), relation_type, F.lit("' is not imported")),
                False,
            ),
            (
                broken & is_area,
                F.concat(F.lit("Way has area=yes but only "), nodes.cast("string"), F.lit(" nodes")),
                True,
            ),
            (broken, F.concat(F.lit("Way has only "), nodes.cast("string"), F.lit(" node(s)")), True),
            (F.size(reasons) == 0, F.lit("No tags match the import rules"), False),
            (
                ~F.array_contains(reasons, F.lit("")),
                F.concat(F.lit("Rejected by all layers: "), F.array_join(reasons, "; ")),
                True,
            ),
        ]
        outcome = F.struct(F.lit(None).cast("string").alias("text"), F.lit(False).alias("commentable"))
        for condition, message, commentable in reversed(cases):
            found = F.struct(message.alias("text"), F.lit(commentable).alias("commentable"))
            outcome = F.when(F.coalesce(condition, F.lit(False)), found).otherwise(outcome)
        return outcome

    decided = elements.withColumn("_outcome", bind(F.coalesce(reasons, F.array().cast("array<string>")), decide))
    return decided.withColumns(
        {"skip_reason": F.col("_outcome.text"), "commentable": F.col("_outcome.commentable")}
    ).drop("_outcome")


def _reject_with_coastline(layer: str, reject: dict[str, list[str]]) -> dict[str, list[str]]:
    """Coastlines are kept out of every layer that maps ``natural``."""
    if "natural" not in LAYERS[layer].mapping:
        return reject
    return {**reject, "natural": ["coastline"]}


def _literal_map(values: dict[str, list[str]]) -> Column:
    pairs = [
        F.struct(F.lit(k).alias("key"), F.array(*[F.lit(v) for v in vs]).alias("value"))
        for k, vs in values.items()
    ]
    if not pairs:
        return F.map_from_entries(F.array().cast("array<struct<key:string,value:array<string>>>"))
    return F.map_from_entries(F.array(*pairs))
