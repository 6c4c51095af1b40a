"""Shapes to objects of other libraries, on the driver or inside a task."""

from __future__ import annotations

from typing import Any


def to_shapely(shape: Any) -> Any:
    """A collected shape (Row or dict) as a shapely geometry, where shapely is installed; null gives None."""
    if shape is None:
        return None
    from shapely import geometry

    s = shape.asDict() if hasattr(shape, "asDict") else dict(shape)
    if "x" in s:
        return geometry.Point(s["x"], s["y"])
    if "startX" in s:
        return geometry.LineString([(s["startX"], s["startY"]), (s["endX"], s["endY"])])
    vertices = list(zip(s["xcoordinates"], s["ycoordinates"]))
    ends = [*s["indices"][1:], len(vertices)]
    parts = [vertices[a:b] for a, b in zip(s["indices"], ends)]
    if s["type"] == 3:
        return geometry.LineString(parts[0]) if len(parts) == 1 else geometry.MultiLineString(parts)
    return geometry.Polygon(parts[0], parts[1:])
