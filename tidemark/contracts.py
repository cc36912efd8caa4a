"""Data contracts: field kinds, value rules, key and compare columns.

A contract is plain data. Registering one more makes every operator of the package
work on a new kind of source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.coerce import as_flag, as_instant, as_key, as_number, as_text, is_json, json_kind, json_text

# Issue texts.
INVALID_KEY = "Invalid input"
MISSING = "Required"
NOT_A_NUMBER, NOT_TEXT, NOT_A_FLAG = "Expected number, received ", "Expected string, received ", "Expected boolean, received "
NAN = "Expected number, received nan"
NOT_POSITIVE = "Number must be greater than 0"
EMPTY_TEXT = "String must contain at least 1 character(s)"
BAD_EMAIL = "Invalid email"
BAD_DATE = "Invalid date"
REQUIRED_EMPTY = "Required field is missing or empty"
DUPLICATE = "Duplicate value found"

# Fixed value: the mail address pattern of the zod schema library, version 3, which ignores case.
EMAIL_TEXT = r"^(?!\.)(?!.*\.\.)[A-Za-z0-9_'+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$"

SPARK_TYPES: dict[str, T.DataType] = {
    "key": T.StringType(),
    "number": T.DoubleType(),
    "text": T.StringType(),
    "email": T.StringType(),
    "date": T.TimestampNTZType(),
    "flag": T.BooleanType(),
}

CASTS: dict[str, Callable[[Column, T.DataType], Column]] = {
    "key": as_key,
    "number": as_number,
    "text": as_text,
    "email": as_text,
    "date": as_instant,
    "flag": as_flag,
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    optional: bool = False
    default: object = None

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.kind]

    def cast(self, raw: Column, dtype: T.DataType) -> Column:
        return CASTS[self.kind](raw, dtype)

    def filled(self, value: Column) -> Column:
        return value if self.default is None else F.coalesce(value, F.lit(self.default))

    def issue(self, raw: Column, value: Column, dtype: T.DataType = T.StringType()) -> Column:
        """Text of the first rule a raw value of this type and its cast break, NULL when there is none."""
        found = json_kind(raw) if is_json(dtype) else F.lit("string")

        def unlike(expected: str) -> tuple[Column, Column]:
            return value.isNull(), F.concat(F.lit(expected), found)

        if self.kind == "number":
            checks = [unlike(NOT_A_NUMBER), (F.isnan(value), F.lit(NAN)), (value <= 0, F.lit(NOT_POSITIVE))]
        elif self.kind == "text":
            checks = [unlike(NOT_TEXT), (F.length(value) == 0, F.lit(EMPTY_TEXT))]
        elif self.kind == "email":
            checks = [unlike(NOT_TEXT), (~valid_email(value), F.lit(BAD_EMAIL))]
        elif self.kind == "date":
            checks = [(value.isNull(), F.lit(BAD_DATE))]
        elif self.kind == "flag":
            checks = [unlike(NOT_A_FLAG)]
        else:
            checks = [(value.isNull(), F.lit(INVALID_KEY))]
        absent = {"key": INVALID_KEY, "date": BAD_DATE}.get(self.kind, MISSING)
        may_be_absent = self.optional or self.default is not None
        message = F.when(raw.isNull(), F.lit(None if may_be_absent else absent))
        for broken, text in checks:
            message = message.when(broken, text)
        return message.cast("string")


@dataclass(frozen=True)
class Contract:
    name: str
    role: str  # "fact" or "dimension"
    fields: tuple[Field, ...]
    required: tuple[str, ...] = ()
    unique: tuple[str | tuple[str, ...], ...] = ()
    key: tuple[str, ...] = ("id",)
    compare: tuple[str, ...] = ()
    table: str = field(default="")

    def __post_init__(self) -> None:
        if self.role not in ("fact", "dimension"):
            raise ValueError(f"contract {self.name}: unknown role {self.role!r}")
        if not self.table:
            object.__setattr__(self, "table", f"{'fact' if self.role == 'fact' else 'dim'}_{self.name}")
        known = {f.name for f in self.fields}
        for column in (*self.required, *self.unique_columns, *self.compare):
            if column not in known:
                raise ValueError(f"contract {self.name}: no field {column!r}")

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def unique_keys(self) -> list[tuple[str, ...]]:
        """Columns that may not repeat together: those declared, and the key of a dimension,
        since a merge takes at most one row per key from a batch."""
        declared = [(u,) if isinstance(u, str) else tuple(u) for u in self.unique]
        covered = any(set(u) <= set(self.key) for u in declared)
        if self.role == "dimension" and not covered and set(self.key) <= set(self.columns):
            declared.append(tuple(self.key))
        return declared

    @property
    def unique_columns(self) -> list[str]:
        return list(dict.fromkeys(c for names in self.unique_keys for c in names))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type) for f in self.fields])


def valid_email(value: Column) -> Column:
    return value.rlike(EMAIL_TEXT)


def raw_columns(df: DataFrame, contract: Contract) -> dict[str, tuple[Column, T.DataType]]:
    """Raw expression and type of every contract field; a column the source lacks is NULL."""
    present = {f.name: f.dataType for f in df.schema.fields}
    return {
        f.name: (F.col(f.name), present[f.name])
        if f.name in present
        else (F.lit(None).cast("string"), T.StringType())
        for f in contract.fields
    }


def typed_projection(df: DataFrame, contract: Contract, keep: tuple[str, ...] = ()) -> DataFrame:
    """Contract columns in contract types; other columns are dropped unless kept by name."""
    raw = raw_columns(df, contract)
    return df.select(*keep, *[f.filled(f.cast(*raw[f.name])).alias(f.name) for f in contract.fields])


def field_issue(df: DataFrame, contract: Contract, name: str) -> Column:
    """Broken rule of one field of the contract, as a column over ``df``."""
    found = next(f for f in contract.fields if f.name == name)
    raw, dtype = raw_columns(df, contract)[name]
    return found.issue(raw, found.cast(raw, dtype), dtype)


def missing_required(df: DataFrame, contract: Contract, name: str) -> Column:
    raw, dtype = raw_columns(df, contract)[name]
    if is_json(dtype):
        return raw.isNull() | (json_text(raw) == "")
    return raw.isNull() | (raw == "") if isinstance(dtype, T.StringType) else raw.isNull()


REGISTRY: dict[str, Contract] = {}


def register_contract(contract: Contract) -> Contract:
    REGISTRY[contract.name] = contract
    return contract


def contract_named(name: str) -> Contract:
    if name not in REGISTRY:
        raise KeyError(f"no contract is registered as {name!r}")
    return REGISTRY[name]


def _versioned() -> tuple[Field, ...]:
    return (
        Field("valid_from", "date"),
        Field("valid_to", "date", optional=True),
        Field("is_current", "flag", default=True),
    )


SALES = register_contract(
    Contract(
        name="sales",
        role="fact",
        fields=(
            Field("id", "key"),
            Field("product_id", "key"),
            Field("customer_id", "key"),
            Field("quantity", "number"),
            Field("amount", "number"),
            Field("sale_date", "date"),
            Field("region", "text"),
            Field("updated_at", "date", optional=True),
        ),
        required=("id", "product_id", "customer_id", "quantity", "amount"),
        unique=("id",),
    )
)

PRODUCT = register_contract(
    Contract(
        name="product",
        role="dimension",
        fields=(
            Field("product_id", "key"),
            Field("product_name", "text"),
            Field("category", "text"),
            Field("price", "number"),
            *_versioned(),
        ),
        required=("product_id", "product_name", "category"),
        unique=("product_id",),
        key=("product_id",),
        compare=("product_name", "category", "price"),
    )
)

CUSTOMER = register_contract(
    Contract(
        name="customer",
        role="dimension",
        fields=(
            Field("customer_id", "key"),
            Field("customer_name", "text"),
            Field("email", "email", optional=True),
            Field("segment", "text"),
            *_versioned(),
        ),
        required=("customer_id", "customer_name"),
        unique=("customer_id",),
        key=("customer_id",),
        compare=("customer_name", "email", "segment"),
    )
)
