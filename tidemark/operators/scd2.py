"""Type 2 history: change detection, new versions, closed versions, versioned reads.

A dimension frame has the contract's columns with ``valid_from``, ``valid_to`` and
``is_current``. The batch is taken to be much smaller than the dimension: the current
versions are first cut down to the keys of the batch, and only those are compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.naming import all_of, any_of, matches, member_of
from tidemark.operators.staging import HOT_ROWS, first_per_key, hot_keys, join_hot_apart
from tidemark.sources.marks import instant_literal

VALIDITY = ("valid_from", "valid_to", "is_current")
OLD = "_old_"
INSERT, CLOSE = "insert", "close"


def scd2_current(dimension: DataFrame) -> DataFrame:
    return dimension.filter("is_current")


def one_current_per_key(current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Should a key have several current versions, the latest one counts."""
    return first_per_key(current, keys, [F.col("valid_from").desc_nulls_last()])


def _changed(compare: Sequence[str]) -> Column:
    return any_of([~F.col(c).eqNullSafe(F.col(OLD + c)) for c in compare])


def compare_with_current(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str],
    unique_keys: bool = False,
    hot_rows: int = HOT_ROWS,
    cut: bool = True,
) -> DataFrame:
    """Incoming rows with the current version of their key (``_old_`` columns) and
    ``_change``: ``new``, ``changed`` or ``same``.

    ``unique_keys`` says that neither side repeats a key or lacks one (the validation gate
    and the merge itself prove it in a refresh), which saves counting the rows per key.
    Without it, the latest current version of a key counts, every incoming row is
    compared, and a missing key equals a missing key. With unique keys, ``cut`` says whether
    the current versions are first cut down to the keys of the batch; where it names most of
    them, that moves the batch once more for nothing.
    """
    if unique_keys:
        touched = member_of(current, incoming, keys, "left_semi", null_safe=False) if cut else current
        probed = incoming.join(
            touched.select(*_old_columns(touched)), matches(keys, OLD, null_safe=False), "left"
        )
    else:
        counted = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        touched = one_current_per_key(member_of(current, counted, keys, "left_semi"), keys)
        lookup = touched.select(*keys, *_old_columns(touched))
        hot = hot_keys(counted, keys, "_n", hot_rows)
        probed = join_hot_apart(incoming, lookup, keys, hot, "left")
    state = (
        F.when(F.col("_known").isNull(), F.lit("new"))
        .when(_changed(compare), F.lit("changed"))
        .otherwise(F.lit("same"))
    )
    return probed.withColumn("_change", state).drop("_known")


def _old_columns(versions: DataFrame) -> list[Column]:
    return [*[F.col(c).alias(OLD + c) for c in versions.columns], F.lit(True).alias("_known")]


def started_at(as_of: datetime) -> dict[str, Column]:
    """Validity of a version that starts."""
    return {
        "valid_from": instant_literal(as_of),
        "valid_to": F.lit(None).cast("timestamp_ntz"),
        "is_current": F.lit(True),
    }


def _ended_at(as_of: datetime) -> dict[str, Column]:
    return {"valid_from": F.col(OLD + "valid_from"), "valid_to": instant_literal(as_of), "is_current": F.lit(False)}


def _version(columns: Sequence[str], as_of: datetime, closing: bool) -> list[Column]:
    """Columns of a version that starts (or ends) at ``as_of``."""
    validity = _ended_at(as_of) if closing else started_at(as_of)
    return [
        (validity[c] if c in validity else F.col(OLD + c) if closing else F.col(c)).alias(c) for c in columns
    ]


def _versions(current: DataFrame, incoming: DataFrame, as_of: datetime) -> tuple[Column, Column]:
    """The version an incoming row starts and the one it ends, as structs with ``_op``."""
    columns = current.columns
    missing = [c for c in columns if c not in incoming.columns and c not in VALIDITY]
    if missing:
        raise ValueError(f"incoming rows lack {missing}")
    return (
        F.struct(F.lit(INSERT).alias("_op"), *_version(columns, as_of, closing=False)),
        F.struct(F.lit(CLOSE).alias("_op"), *_version(columns, as_of, closing=True)),
    )


def scd2_delta(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str],
    as_of: datetime,
    unique_keys: bool = False,
    hot_rows: int = HOT_ROWS,
    cut: bool = True,
) -> DataFrame:
    """The versions a batch adds (``_op`` insert) and ends (``_op`` close)."""
    new_version, old_version = _versions(current, incoming, as_of)
    probed = compare_with_current(current, incoming, keys, compare, unique_keys, hot_rows, cut)
    touched = probed.filter(F.col("_change") != "same")
    if unique_keys:
        both = F.when(F.col("_change") == "changed", F.array(new_version, old_version))
        return touched.select(F.explode(F.coalesce(both, F.array(new_version))).alias("_v")).select("_v.*")
    inserts = touched.select(new_version.alias("_v")).select("_v.*")
    closes = touched.filter(F.col("_change") == "changed").select(old_version.alias("_v")).select("_v.*")
    return inserts.unionByName(closes.dropDuplicates(list(keys)))


def scd2_first(current: DataFrame, incoming: DataFrame, as_of: datetime) -> DataFrame:
    """The delta of a batch of unique keys where there is no version yet: each row starts one."""
    new_version, _ = _versions(current, incoming, as_of)
    return incoming.select(new_version.alias("_v")).select("_v.*")


def scd2_inserts(*args, **kwargs) -> DataFrame:
    """New versions of a batch; arguments as for :func:`scd2_delta`."""
    return scd2_delta(*args, **kwargs).filter(F.col("_op") == INSERT).drop("_op")


def scd2_closes(*args, **kwargs) -> DataFrame:
    """Versions a batch ends; arguments as for :func:`scd2_delta`."""
    return scd2_delta(*args, **kwargs).filter(F.col("_op") == CLOSE).drop("_op")


def scd2_change_detect(
    current: DataFrame, incoming: DataFrame, keys: Sequence[str], compare: Sequence[str], **options
) -> DataFrame:
    """Key and change state (``new``, ``changed``, ``same``) of every incoming row."""
    probed = compare_with_current(current, incoming, keys, compare, **options)
    return probed.select(*keys, F.col("_change").alias("change"))


def still_open(
    current: DataFrame, delta: DataFrame, keys: Sequence[str], unique_keys: bool = False
) -> DataFrame:
    """Current versions the delta leaves alone."""
    ended = delta.filter(F.col("_op") == CLOSE)
    if unique_keys:
        return member_of(current, ended, keys, "left_anti", null_safe=False)
    return member_of(current, ended, [*keys, "valid_from"], "left_anti")


def scd2_merge(
    dimension: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str],
    as_of: datetime,
    unique_keys: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The whole dimension after the batch. Keys the batch lacks stay as they are.

    With unique keys one left join from the current versions to the batch tells the fate
    of each of them, and a batch below the broadcast threshold leaves them in place.
    """
    current = scd2_current(dimension)
    closed = dimension.filter(~F.col("is_current"))
    if not unique_keys:
        delta = scd2_delta(current, incoming, keys, compare, as_of, hot_rows=hot_rows)
        return closed.unionByName(still_open(current, delta, keys)).unionByName(delta.drop("_op"))
    new_version, old_version = _versions(current, incoming, as_of)
    old = current.select(*_old_columns(current))
    met = old.join(incoming, matches(keys, OLD, null_safe=False), "left")
    same_version = F.struct(
        F.lit("keep").alias("_op"), *[F.col(OLD + c).alias(c) for c in current.columns]
    )
    ended = F.col(keys[0]).isNotNull() & _changed(compare)
    fate = F.when(ended, F.array(old_version, new_version)).otherwise(F.array(same_version))
    known = met.select(F.explode(fate).alias("_v")).select("_v.*")
    touched = member_of(current.select(*keys), incoming, keys, "left_semi", null_safe=False)
    unknown = member_of(incoming, touched, keys, "left_anti", null_safe=False)
    added = unknown.select(new_version.alias("_v")).select("_v.*")
    return closed.unionByName(known.drop("_op")).unionByName(added.drop("_op"))


def scd2_as_of(dimension: DataFrame, moment: datetime) -> DataFrame:
    """The versions valid at a moment."""
    at = instant_literal(moment)
    open_end = F.col("valid_to").isNull() | (F.col("valid_to") > at)
    return dimension.filter((F.col("valid_from") <= at) & open_end)


def _slot(width: str, column: str) -> Column:
    return F.date_trunc(width, F.col(column)).cast("timestamp_ntz").alias("_slot")


# Versions of one key from which on its history is cut into slots.
LONG_HISTORY = 64


def as_of_join(
    facts: DataFrame,
    dimension: DataFrame,
    key: str | Sequence[str],
    at: str,
    attributes: Sequence[str],
    slot: str = "day",
    dimension_key: str | Sequence[str] | None = None,
    long_history: int = LONG_HISTORY,
) -> DataFrame:
    """Every fact with the attributes of the version valid at its own time, NULL when
    there is none.

    Where no key has a long history (the dimension alone tells) this is an equi-join on
    the key with the time as a further condition: the facts are read once, and not moved if
    the dimension can be broadcast. Beyond that time is cut into slots, see
    :func:`slotted_as_of_join`; the rows are the same.
    """
    clash = sorted(set(attributes) & set(facts.columns))
    if clash:
        raise ValueError(f"the facts already have columns {clash}")
    keys = [key] if isinstance(key, str) else list(key)
    own = keys if dimension_key is None else [dimension_key] if isinstance(dimension_key, str) else list(dimension_key)
    longest = dimension.groupBy(*own).count().agg(F.max("count").alias("n")).first()["n"] or 0
    version = F.struct("valid_from", "valid_to", *attributes).alias("_v")
    versions = dimension.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(own)], version)
    if longest >= long_history:
        return slotted_as_of_join(facts, versions, keys, at, attributes, slot)
    joined = facts.join(versions, all_of([*_on(keys), _valid_at(at)]), "left")
    return joined.select(*facts.columns, *[F.col("_v")[a].alias(a) for a in attributes])


def _on(keys: Sequence[str]) -> list[Column]:
    return [F.col(c) == F.col(f"_k{n}") for n, c in enumerate(keys)]


def _valid_at(at: str) -> Column:
    return (F.col("_v.valid_from") <= F.col(at)) & (F.col("_v.valid_to").isNull() | (F.col(at) < F.col("_v.valid_to")))


def slotted_as_of_join(
    facts: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, attributes: Sequence[str], slot: str
) -> DataFrame:
    """As-of join for long histories. ``versions``: the key as ``_k0``, ``_k1``, ..., and ``_v``.

    Time is cut into slots. A slot of a key needs the versions that start in it and the
    one version still open when it begins; that one is found from the last version of
    each earlier slot, so a fact is compared with a few versions instead of a key's whole
    history, and a hot key spreads over its slots. The join itself is an equi-join on key
    and slot with the facts on the left, which AQE may split further.
    """
    names = [f"_k{n}" for n in range(len(keys))]
    starts = versions.select(*names, _slot(slot, "_v.valid_from"), "_v")
    slotted = facts.select("*", _slot(slot, at))

    latest = F.struct("_v.valid_from", F.col("_v.valid_to").isNull(), "_v.valid_to")
    last_started = starts.groupBy(*names, "_slot").agg(F.max_by("_v", latest).alias("_v"))
    asked = slotted.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], "_slot").distinct()
    timeline = last_started.withColumn("_asked", F.lit(False)).unionByName(
        asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True
    )
    # In one slot the question sorts first, so it sees the versions of earlier slots only.
    earlier = (
        Window.partitionBy(*names)
        .orderBy("_slot", F.col("_asked").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        timeline.withColumn("_v", F.last("_v", ignorenulls=True).over(earlier))
        .filter(F.col("_asked") & F.col("_v").isNotNull())
        .select(*names, "_slot", "_v")
    )
    candidates = starts.unionByName(carried).withColumnRenamed("_slot", "_s")
    same = all_of([*_on(keys), F.col("_slot") == F.col("_s"), _valid_at(at)])
    joined = slotted.join(candidates, same, "left")
    return joined.select(*facts.columns, *[F.col("_v")[a].alias(a) for a in attributes])
