"""Nearest wires at any distance, and lines of pointers."""

import json
import math
import random

import pytest

from graphweft.operators import routes, spatial


def distance(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(x - ax - t * dx, y - ay - t * dy)


@pytest.mark.parametrize(("n", "k", "box"), [(400, 1, 16), (400, 5, 4), (3, 5, 16), (1, 1, 256)])
def test_nearest_k_is_that_of_all_pairs(spark, monkeypatch, n, k, box):
    """Dense clusters, long wires, and points far from all of them."""
    monkeypatch.setattr(spatial, "BOX_WIRES", box)
    rnd, wires = random.Random(n + k), []
    for i in range(n):
        x, y = (rnd.gauss(0, 3), rnd.gauss(0, 3)) if i % 3 else (rnd.uniform(-5000, 9000), rnd.uniform(-300, 400))
        reach = 2000 if i % 50 == 1 else 5
        wires.append((i, "Asset" if i % 7 == 3 else "Call", x, y, x + rnd.uniform(-reach, reach), y + rnd.uniform(-reach, reach)))
    points = [(i, rnd.gauss(0, 4), rnd.gauss(0, 4)) for i in range(40)] + [(100 + i, rnd.uniform(-20_000, 20_000), rnd.uniform(-20_000, 20_000)) for i in range(40)] + [(200, 1e7, -1e7)]
    got = {}
    found = spatial.nearest_k(spark.createDataFrame([*wires, (None, "Call", 0.0, 0.0, 0.0, 0.0)], "wire long, kind string, ax double, ay double, bx double, by double"), spark.createDataFrame([*points, (300, None, 1.0)], "point long, x double, y double"), k, ["Call"])
    for r in found.collect():
        got.setdefault(r["point"], []).append((r["rank"], r["distance"], r["wire"]))
    shown = [w for w in wires if w[1] == "Call"]
    for p, x, y in points:
        want = sorted((round(distance(x, y, *w[2:]), 9), w[0]) for w in shown)[:k]
        own = sorted(got[p])
        assert [r for r, *_ in own] == list(range(1, len(want) + 1)) and all(abs(a - b) < 1e-6 for (_, a, _), (b, _) in zip(own, want, strict=True))


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "wire long, kind string, ax double, ay double, bx double, by double")
    assert spatial.nearest_k(none, spark.createDataFrame([(1, 0.0, 0.0)], "point long, x double, y double"), 2, ["Call"]).collect() == []


def test_pointer_lines(spark):
    """Every key and element of random documents, by its own line as a plain walk over the printed text gives it."""
    rnd = random.Random(2)

    def made(depth):
        if depth == 0 or rnd.random() < 0.2:
            return rnd.choice([1, None, "a:b", "{", True])
        if rnd.random() < 0.5:
            return {rnd.choice(["a", "x/y", "m~n", "0", 'q"'])[:3] + str(i): made(depth - 1) for i in range(rnd.randrange(1, 4))}
        return [made(depth - 1) for _ in range(rnd.randrange(1, 4))]

    rows = []
    for i in range(30):
        doc, want, lines = {"r": made(3)}, {"": 1}, ["{"]

        def show(value, path, indent, end, want=want, lines=lines):
            """Prints value after what stands on the last line."""
            if isinstance(value, (dict, list)) and value:
                opening, closing = "{}" if isinstance(value, dict) else "[]"
                lines[-1] += opening
                items = list(value.items() if isinstance(value, dict) else enumerate(value))
                for n, (key, inner) in enumerate(items):
                    own = f"{path}/{str(key).replace('~', '~0').replace('/', '~1')}"
                    lines.append(" " * indent + (json.dumps(key) + ": " if isinstance(value, dict) else ""))
                    want[own] = len(lines)
                    show(inner, own, indent + 1, "," if n + 1 < len(items) else "")
                lines.append(" " * indent + closing + end)
            else:
                lines[-1] += json.dumps(value) + end

        lines[0] = ""
        show(doc, "", 1, "")
        text = "\n".join(lines)
        assert json.loads(text) == doc
        rows += [(text, p, n) for p, n in want.items()] + [(text, "/none", 0), (None, "/r", None), (text, None, None)]
    got = routes.pointer_lines(spark.createDataFrame(rows, "text string, pointer string, want int")).collect()
    assert all(r["line"] == r["want"] for r in got) and len(got) == len(rows)
