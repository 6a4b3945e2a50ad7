"""Nesting and orientation of rings, by a sweep line over each polygon's edges; polygons go through Arrow batches, whole layers in parallel.

The sweep meets the rings at their leftmost corners. The edge directly below such a corner belongs to a ring that was met before: if its inside
is above that edge, it holds the new ring; if not, both have the same holder. So a polygon of n edges takes n log n steps, however many rings it has.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from arealis.operators.geometry import GEOM, ring_area

Ring = list[tuple[float, float]]


class _Sweep:
    """Edges that the line crosses, from the lowest up; they don't cross each other, so their order holds while it moves."""

    def __init__(self) -> None:
        self.edges: list[tuple] = []  # (x0, y0, x1, y1, slope, ring, inside is above)

    @staticmethod
    def _at(x: float):
        return lambda e: (e[1] + (x - e[0]) * e[4], e[4])

    def add(self, edge: tuple) -> None:
        self.edges.insert(bisect_left(self.edges, (edge[1], edge[4]), key=self._at(edge[0])), edge)

    def drop(self, edge: tuple) -> None:
        at = bisect_left(self.edges, (edge[3], edge[4]), key=self._at(edge[2]))
        near = next((i for i in (at, at - 1, at + 1) if 0 <= i < len(self.edges) and self.edges[i] is edge), None)
        self.edges.pop(near if near is not None else next(i for i, e in enumerate(self.edges) if e is edge))

    def below(self, x: float, y: float, slope: float, ring: int) -> tuple | None:
        at = bisect_right(self.edges, (y, slope), key=self._at(x))  # an edge that both share lies below
        while at and self.edges[at - 1][5] == ring:
            at -= 1
        return self.edges[at - 1] if at else None


def depths(rings: list[Ring]) -> list[int]:
    """How many other rings hold each ring: odd ones are holes. Rings are closed and may touch, but not cross; flat rings hold nothing."""
    sweep, events, out = _Sweep(), [], [0] * len(rings)
    for k, ring in enumerate(rings):
        up = ring_area(ring) > 0
        flat = ring_area(ring) == 0
        edges = []
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if ax != bx and not flat:
                left = (ax, ay, bx, by) if ax < bx else (bx, by, ax, ay)
                edges.append((*left, (by - ay) / (bx - ax), k, (ax < bx) == up))
        if not ring:
            continue
        x, y = min(ring)
        slope = min((e[4] for e in edges if e[:2] == (x, y)), default=0.0)
        events.append((x, 2, y, slope, k, None))
        for e in edges:
            events.append((e[0], 1, e[1], e[4], k, e))
            events.append((e[2], 0, e[3], e[4], k, e))
    holder: list[int | None] = [None] * len(rings)
    for x, kind, y, slope, k, edge in sorted(events, key=lambda e: e[:5]):
        if kind == 0:
            sweep.drop(edge)
        elif kind == 1:
            sweep.add(edge)
        else:
            found = sweep.below(x, y, slope, k)
            if found is not None:
                holder[k] = found[5] if found[6] else holder[found[5]]
                out[k] = out[holder[k]] + 1 if holder[k] is not None else 0
    return out


def mend(rings: list[Ring]) -> tuple[list[Ring], list[int]]:
    """Rings closed, outer ones clockwise and holes counter-clockwise, in their order, with how many others hold each."""
    closed = [r if not r or r[0] == r[-1] else [*r, r[0]] for r in rings]
    deep = depths(closed)
    return [r[::-1] if (ring_area(r) > 0) == (d % 2 == 0) else r for r, d in zip(closed, deep, strict=True)], deep


def repair(df: DataFrame, geom: str = "geom") -> DataFrame:
    """df with the rings of its polygons closed and turned the right way, and `depths`, how many other rings hold each ring; a NULL geometry stays, with NULL."""
    fields = [f for f in df.schema.fields if f.name != "depths"]
    schema = T.StructType([*fields, T.StructField("depths", T.ArrayType(T.IntegerType()))])
    kind, names = to_arrow_type(T.DataType.fromDDL(GEOM)), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, deep = [], []
            for g in batch.column(geom).to_pylist():
                if g is None:
                    shapes.append(None)
                    deep.append(None)
                    continue
                points = [(p["x"], p["y"]) for p in g["points"]]
                rings, d = mend([points[a:b] for a, b in zip(g["parts"], [*g["parts"][1:], len(points)], strict=True)])
                starts = [0]
                for r in rings[:-1]:
                    starts.append(starts[-1] + len(r))
                shapes.append({"type": g["type"], "parts": starts if rings else [], "points": [{"x": x, "y": y} for r in rings for x, y in r]})
                deep.append(d)
            columns = [pa.array(shapes, kind) if n == geom else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(deep, pa.list_(pa.int32()))], names=[*names, "depths"])

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)
