"""Small graphs with known cores and labels, for the synthetic queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "g string, s string, p string, o string"


def _n(*i: int) -> str:
    return "_:n" + ".".join(map(str, i))


def _cycle(n: int, at: int = 0) -> list[tuple[str, str]]:
    return [(_n(at + i), _n(at + (i + 1) % n)) for i in range(n)]


def _both(links: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return links + [(b, a) for a, b in links]


def _grid(w: int, h: int) -> list[tuple[str, str]]:
    return _both([(_n(x, y), _n(x + 1, y)) for x in range(w - 1) for y in range(h)] + [(_n(x, y), _n(x, y + 1)) for x in range(w) for y in range(h - 1)])


_PATH = [(_n(i), _n(i + 1)) for i in range(4)]

#: family: (links of one predicate, blank nodes in, triples in, blank nodes of the core, triples of the core)
FAMILIES = {
    "cycle5": (_cycle(5), 5, 5, 5, 5),
    "two cycles": (_cycle(3) + _cycle(3, 3), 6, 6, 3, 3),
    "cycles 2 and 4": (_cycle(2) + _cycle(4, 2), 6, 6, 2, 2),
    "even cycle": (_both(_cycle(6)), 6, 12, 2, 2),
    "odd cycle": (_both(_cycle(5)), 5, 10, 5, 10),
    "clique4": ([(_n(i), _n(j)) for i in range(4) for j in range(4) if i != j], 4, 12, 4, 12),
    "grid 2x3": (_grid(2, 3), 6, 14, 2, 2),
    "path": (_PATH, 5, 4, 5, 4),
    "path and loop": ([*_PATH[:3], ("_:x", "_:x")], 5, 4, 1, 1),
    "star": ([("_:a", f"_:b{i}") for i in range(3)], 4, 3, 2, 1),
    "onto ground": ([("_:a", "_:b"), ("<u>", "<v>")], 2, 2, 0, 1),
}


def synthetic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, a, "<p>", b) for name, (links, *_) in FAMILIES.items() for a, b in links], _SCHEMA)


#: Two directed 3-cycles and a ground triple.
GOLDEN = [("_:a", "_:b"), ("_:b", "_:c"), ("_:c", "_:a"), ("_:x", "_:y"), ("_:y", "_:z"), ("_:z", "_:x"), ("<u>", "<v>")]
# Their canonical triples under md5.
GOLDEN_LABELLED = [
    ("<u>", "<v>"),
    ("_:SK0036cc1684b47a2ab9d572712e9bf6d4b6", "_:SK003e2cfe64ac8abefd0daec5da3bda7422"),
    ("_:SK003e2cfe64ac8abefd0daec5da3bda7422", "_:SK00eea00e382802360d4926a9d2a3d2648a"),
    ("_:SK00b18eb44df51d9d026169a1751071c678", "_:SK00d9c27c19e1a5093ebd351941c8bd1664"),
    ("_:SK00c122c4399935a5128591dd7d68d9b640", "_:SK00b18eb44df51d9d026169a1751071c678"),
    ("_:SK00d9c27c19e1a5093ebd351941c8bd1664", "_:SK00c122c4399935a5128591dd7d68d9b640"),
    ("_:SK00eea00e382802360d4926a9d2a3d2648a", "_:SK0036cc1684b47a2ab9d572712e9bf6d4b6"),
]


def golden(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("golden", a, "<p>", b) for a, b in GOLDEN], _SCHEMA)
