"""What a refresh works on: sources and cubes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from tidemark.contracts import contract_named

# Attributes a dimension adds to a cube unless the cube names others.
DEFAULT_ATTRIBUTES = {"product": ("category",), "customer": ("segment",)}


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    schema: str
    options: Mapping[str, object]
    watermark_column: str | None = None
    insert_if_absent: bool = False
    # Columns that put the rows of a batch in order; several files have none among them.
    order_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Cube:
    """Measures of a fact contract by attributes of dimensions and of the fact itself.

    Attributes are those of the current versions, or with ``versions_at``, a time column of
    the fact, those valid at that time.
    """

    name: str
    sources: tuple[str, ...]
    fact: str = "sales"
    dimensions: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    fact_attributes: tuple[str, ...] = ("region",)
    attributes: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(DEFAULT_ATTRIBUTES))
    versions_at: str | None = None

    def attributes_of(self, dimension: str) -> tuple[str, ...]:
        return tuple(self.attributes.get(dimension, ()))

    @property
    def tables(self) -> list[str]:
        """Tables the cube is built from."""
        return [contract_named(name).table for name in (self.fact, *self.dimensions)]

    @property
    def by(self) -> list[str]:
        return [*self.fact_attributes, *[a for d in self.dimensions for a in self.attributes_of(d)]]


@dataclass(frozen=True)
class Job:
    sources: tuple[Source, ...]
    cubes: tuple[Cube, ...]

    def cubes_named(self, name: str | None) -> tuple[Cube, ...]:
        chosen = tuple(c for c in self.cubes if name is None or c.name == name)
        if not chosen:
            raise ValueError(f"the job has no cube {name!r}")
        return chosen

    def sources_of(self, cube: Cube) -> list[Source]:
        """In configuration order; names that are not configured are passed over."""
        return [s for s in self.sources if s.name in cube.sources]


def _csv_options(c: Mapping) -> dict:
    return {"path": c["filePath"], "delimiter": c.get("delimiter") or ",", "has_header": c.get("hasHeader", True)}


def _postgres_options(c: Mapping) -> dict:
    options = {
        "url": f"jdbc:postgresql://{c['host']}:{c['port']}/{c['database']}",
        "user": c["user"],
        "password": c["password"],
        "driver": "org.postgresql.Driver",
    }
    return {**options, **{k: c[k] for k in ("table", "query") if c.get(k)}}


def _rest_options(c: Mapping) -> dict:
    options = {k: c[k] for k in ("method", "headers", "auth") if c.get(k)}
    return {"urls": [c["url"]], "data_path": c.get("dataPath"), **options}


KINDS = {"csv": ("csv", _csv_options), "postgres": ("jdbc", _postgres_options), "rest": ("rest", _rest_options)}


def job_from_config(config: Mapping) -> Job:
    """A job from a parsed JSON configuration (``sources``, ``cubes``)."""
    sources = []
    for s in config["sources"]:
        if s["type"] not in KINDS:
            raise ValueError(f"no source kind {s['type']!r}")
        kind, options = KINDS[s["type"]]
        sources.append(
            Source(s["name"], kind, s["schema"], options(s["connection"]), s.get("watermarkColumn"))
        )
    cubes = [
        Cube(
            name=c["name"],
            sources=tuple(c["sources"]),
            fact=c["factTable"].removeprefix("fact_"),
            dimensions=tuple(c["dimensions"]),
            measures=tuple(c["measures"]),
        )
        for c in config["cubes"]
    ]
    return Job(tuple(sources), tuple(cubes))
