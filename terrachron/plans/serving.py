"""Which view answers which layer at which zoom."""

from __future__ import annotations

from terrachron.operators.tiles import TOP_ZOOM

# The standard zoom bands.
STANDARD = [(0, 2), (3, 5), (6, 7), (8, 9), (10, 12), (13, 15), (16, 20)]
CLOSE = [(14, 15), (16, 20)]
SHAPE = ["geometry"]
SHAPE_AND_TAGS = ["geometry", "tags"]


def band_name(family: str, lo: int, hi: int) -> str:
    return f"{family}_z{lo}_{hi}" if lo != hi else f"{family}_z{lo}"


def _from(first: int) -> list[tuple[int, int]]:
    return [(lo, hi) for lo, hi in STANDARD if lo >= first]


def _with_five(first: int = 6) -> list[tuple[int, int]]:
    return [(5, 5), *_from(first)]


# Group, layer, view family, excluded columns, bands of its views.
SERVED = [
    ("main", "boundary_lines", "admin_lines", SHAPE, STANDARD),
    ("main", "boundary_centroids", "admin_centroids", SHAPE_AND_TAGS, STANDARD),
    ("main", "maritime_lines", "maritime_lines", SHAPE_AND_TAGS, [(0, 5), (6, 9), (10, 15)]),
    ("main", "place_areas", "place_areas", SHAPE_AND_TAGS, [(14, 20)]),
    ("main", "place_points_centroids", "place_points", SHAPE_AND_TAGS, [(0, 2), (3, 5), (6, 10), (11, 20)]),
    ("main", "water_areas", "water_areas", SHAPE_AND_TAGS, STANDARD),
    ("main", "water_areas_centroids", "water_centroids", SHAPE_AND_TAGS, _from(8)),
    ("main", "water_lines", "water_lines", SHAPE_AND_TAGS, _from(8)),
    ("main", "transport_areas", "transport_areas", SHAPE_AND_TAGS, _from(10)),
    ("main", "transport_lines", "transport_lines", SHAPE_AND_TAGS, _with_five()),
    ("main", "route_lines", "route_lines", SHAPE_AND_TAGS, _with_five()),
    ("main", "transport_points_centroids", "transport_centroids", SHAPE_AND_TAGS, _from(10)),
    ("main", "amenity_areas", "amenity_areas", SHAPE_AND_TAGS, CLOSE),
    ("main", "amenity_points_centroids", "amenity_centroids", SHAPE_AND_TAGS, CLOSE),
    ("main", "buildings", "building_areas", SHAPE_AND_TAGS, CLOSE),
    ("main", "buildings_points_centroids", "building_centroids", SHAPE_AND_TAGS, CLOSE),
    ("main", "landuse_areas", "landuse_areas", SHAPE_AND_TAGS, _from(6)),
    ("main", "landuse_points_centroids", "landuse_centroids", SHAPE_AND_TAGS, _from(6)),
    ("main", "landuse_lines", "landuse_lines", SHAPE_AND_TAGS, CLOSE),
    ("main", "other_areas", "other_areas", SHAPE_AND_TAGS, _from(8)),
    ("main", "other_points_centroids", "other_centroids", SHAPE_AND_TAGS, _from(8)),
    ("main", "other_lines", "other_lines", SHAPE_AND_TAGS, CLOSE),
    ("main", "communication_lines", "communication_lines", SHAPE_AND_TAGS, _from(10)),
    ("main", "address_points", "address_points", SHAPE_AND_TAGS, [(16, 20)]),
    ("admin", "boundaries", "admin_areas", SHAPE_AND_TAGS, STANDARD),
    ("other_boundaries", "non_admin_boundaries_areas", "non_admin_areas", SHAPE_AND_TAGS, STANDARD),
    ("other_boundaries", "non_admin_boundaries_centroids", "non_admin_centroids", SHAPE_AND_TAGS, STANDARD),
    ("land", "land_polygons", "land", SHAPE, STANDARD),
    ("lakes", "lakes", "lakes", SHAPE, [(0, 20)]),
]
# Served layers whose layer name inside the tile differs.
SOURCE_LAYER = {"land_polygons": "land", "lakes": "water_areas"}


def serving_bands() -> list[tuple]:
    """Rows for ``operators.tiles.band_table``; the last band of a layer reaches zoom 20.

    ``max_zoom`` stays empty on the last band.
    """
    rows = []
    for group, layer, family, excluded, bands in SERVED:
        for at, (lo, hi) in enumerate(bands):
            last = at == len(bands) - 1
            view = family if family == "lakes" else band_name(family, lo, hi)
            rows.append(
                (
                    group,
                    layer,
                    SOURCE_LAYER.get(layer, layer),
                    view,
                    lo,
                    TOP_ZOOM if last else hi,
                    None if last else hi,
                    excluded,
                )
            )
    return rows
