"""Facts of a cube summed per batch, by dimension key and by the fact's own attributes.

Facts are only ever added and their keys do not change, so these sums stay right when a
dimension gets new versions. A rebuild sums the batches that came since the last one and
joins the dimensions to the sums, instead of reading all facts again.

Where keys hardly repeat, the sums would be nearly as many as the facts, and to bring the facts
together for them would cost more than it ever saves. Such a batch is entered under its own id:
its facts are read as they are until they are added up with later ones.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import contract_named
from tidemark.operators.cubes import SUMMED, DimensionJoin, collapse_facts, fact_groups, uncollapsed_facts
from tidemark.plans.config import Cube
from tidemark.plans.warehouse import Warehouse, utc_now

# Stored parts from which on they are added up into one.
FOLD_PARTS = 16
# Different dimension keys per fact from which on a batch is not summed.
SINGLE_SHARE = 0.5


def _table(cube: Cube, keys: Sequence[str]) -> str:
    """A cube that is declared anew has sums of its own."""
    declared = repr((cube.fact, tuple(keys), cube.fact_attributes, cube.measures))
    return f"grain_{cube.name}_{zlib.crc32(declared.encode()):08x}"


def collapsed_facts(warehouse: Warehouse, cube: Cube, dimensions: Sequence[DimensionJoin]) -> DataFrame:
    """The facts of a cube as sums, brought up to the last committed batch."""
    contract = contract_named(cube.fact)
    keys = [k for d in dimensions for k in d.fact_keys]
    table = _table(cube, keys)
    folder = f"{warehouse.base}/grains/{table}"
    loads = [c for c in warehouse.commits_of(contract.table) if c["rows_inserted"]]
    if not loads:
        return collapse_facts(warehouse.fact_batches(contract, []), dimensions, cube.by, cube.measures)

    # Sums of facts that were cleared since cover no load that still counts.
    parts = [c for c in warehouse.commits_of(table) if c["covers"] >= loads[0]["seq"]]
    bases = [i for i, c in enumerate(parts) if c["is_base"]]
    parts = parts[bases[-1] :] if bases else parts
    covered = max((c["covers"] for c in parts), default=-1)
    names = [c["batch_id"] for c in parts]
    loaded = {c["batch_id"] for c in loads}

    def enter(part: str, covers: int, is_base: bool = False) -> str:
        warehouse.commit(part, table, None, None, 0, 0, utc_now(), is_base, covers)
        return part

    def write(frame: DataFrame, is_base: bool) -> str:
        part = uuid.uuid4().hex
        frame.write.mode("overwrite").parquet(f"{folder}/{part}")
        return enter(part, loads[-1]["seq"], is_base)

    def read(names: Sequence[str]) -> DataFrame:
        sums = [f"{folder}/{n}" for n in names if n not in loaded]
        frames = [warehouse.spark.read.parquet(*sums)] if sums else []
        single = [n for n in names if n in loaded]
        if single:
            facts = warehouse.fact_batches(contract, single)
            frames.append(uncollapsed_facts(facts, dimensions, cube.by, cube.measures))
        return reduce(DataFrame.unionByName, frames)

    fresh = [c for c in loads if c["seq"] > covered]
    if fresh:
        batches = warehouse.fact_batches(contract, [c["batch_id"] for c in fresh])
        if keys and _mostly_single(batches, fact_groups(batches, dimensions, cube.by)):
            names += [enter(c["batch_id"], c["seq"]) for c in fresh]
        else:
            names.append(write(collapse_facts(batches, dimensions, cube.by, cube.measures), is_base=False))
    names = list(dict.fromkeys(names))
    stored = read(names)
    if len(names) < FOLD_PARTS:
        return stored
    groups = [c for c in stored.columns if c not in (*cube.measures, "row_count")]
    sums = [F.sum(m).cast(SUMMED).alias(m) for m in cube.measures]
    return read([write(stored.groupBy(*groups).agg(*sums, F.sum("row_count").alias("row_count")), is_base=True)])


def _mostly_single(facts: DataFrame, groups: Sequence[str]) -> bool:
    """Whether sums by these columns would be nearly as many as the facts: one pass that moves no row."""
    different = F.approx_count_distinct(F.xxhash64(*groups))
    found = facts.agg(F.count(F.lit(1)).alias("rows"), different.alias("keys")).first()
    return found["keys"] > SINGLE_SHARE * found["rows"]
