"""Where a schema's place in a document lies: in typed columns, whose types are known while the plan is built, or in VARIANT."""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import Predicate, all_of, any_of, sure

DECIMAL = "decimal(38,10)"
TESTS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt, "==": operator.eq}
#: Up to here every whole number is a double.
EXACT = 1 << 53


def _literal(x) -> Column:
    return F.lit(x)


class Typed:
    """A column of a known type; null means that the property is missing (in an array: JSON null)."""

    def __init__(self, column: Column | None, kind: T.DataType, element: bool = False, path: tuple[str, ...] = (), stems: dict[str, Column] | None = None):
        self.column, self.kind, self.element = column, kind, element
        #: Names from the document's root on, and the stored stems of texts by their names joined by dots.
        self.path, self.stored = path, stems or {}

    def stems(self) -> Column | None:
        """Stored stems of this text, if there are any."""
        return self.stored.get(".".join(self.path)) if self.path and not self.element else None

    # What it is.

    def names(self) -> frozenset[str]:
        k = self.kind
        if isinstance(k, T.StructType | T.MapType):
            return frozenset({"object"})
        if isinstance(k, T.ArrayType):
            return frozenset({"array"})
        if isinstance(k, T.BooleanType):
            return frozenset({"boolean"})
        if isinstance(k, T.IntegralType):
            return frozenset({"number", "integer"})
        if isinstance(k, T.NumericType):
            return frozenset({"number"})
        return frozenset({"string"})

    def exists(self) -> Predicate:
        if self.column is None:
            return False
        return True if self.element else self.column.isNotNull()

    def present(self) -> Predicate:
        """There and not null."""
        return False if self.column is None else self.column.isNotNull()

    def is_type(self, names: frozenset[str]) -> Predicate:
        """For a value that exists."""
        own = self.names()
        if "null" in names and self.element and self.column is not None:
            rest = names - {"null"}
            return any_of(self.column.isNull(), self.is_type(rest)) if rest else self.column.isNull()
        held = self.present() if self.element else True
        if own & names:
            return held
        if "integer" in names and own == {"number"}:
            return all_of(held, self.column == F.floor(self.column))
        return False

    # Its parts.

    def field(self, name: str) -> Typed | Variant:
        k = self.kind
        if isinstance(k, T.StructType):
            if name not in k.names:
                return Typed(None, T.NullType())
            inner = self.column.getField(name) if self.column is not None else F.col(f"`{name}`")
            found = value_of(inner, k[name].dataType)
            if isinstance(found, Typed) and not self.element:
                found.path, found.stored = (*self.path, name), self.stored
            return found
        if isinstance(k, T.MapType):
            return value_of(F.try_element_at(self.column, F.lit(name)), k.valueType)
        return Typed(None, T.NullType())

    def field_names(self) -> list[str]:
        return list(self.kind.names) if isinstance(self.kind, T.StructType) else []

    def array(self) -> Column | None:
        return self.column if isinstance(self.kind, T.ArrayType) else None

    def item(self, column: Column) -> Typed | Variant:
        return value_of(column, self.kind.elementType, element=True)

    def size(self) -> Column:
        return F.size(self.column)

    def n_fields(self) -> Column:
        if isinstance(self.kind, T.MapType):
            return F.size(self.column)
        total = F.lit(0)
        for name in self.kind.names:
            total = total + self.field(name).column.isNotNull().cast("int")
        return total

    # Its value.

    def compare(self, test: str, x: int | float) -> Predicate:
        return TESTS[test](self.column, F.lit(x))

    def decimal(self) -> Column:
        return self.column.cast(DECIMAL)

    def text(self) -> Column:
        if isinstance(self.kind, T.TimestampType | T.TimestampNTZType):
            return F.date_format(self.column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return self.column.cast("string")

    def timestamp(self) -> Column:
        return self.column.cast("timestamp_ntz") if isinstance(self.kind, T.TimestampType | T.TimestampNTZType) else F.try_to_timestamp(F.regexp_replace(self.column, r"(?:[Zz]|[+-][0-9]{2}(?::?[0-9]{2})?)$", "")).cast("timestamp_ntz")

    def search_text(self) -> tuple[Column, bool]:
        """Text to search, and whether it is JSON of which all strings count."""
        if isinstance(self.kind, T.ArrayType) and isinstance(self.kind.elementType, T.StringType):
            return F.array_join(self.column, " "), False
        return (self.text(), False) if self.names() == {"string"} else (F.to_json(self.column), True)

    def equals(self, value) -> Predicate:
        """Type-strict equality with a JSON value."""
        if self.column is None:
            return False
        if value is None:
            return self.column.isNull()
        own = self.names()
        if isinstance(value, bool):
            return self.column == F.lit(value) if "boolean" in own else False
        if isinstance(value, int | float):
            return self.column == _literal(value) if "number" in own else False
        if isinstance(value, str):
            return self.text() == F.lit(value) if "string" in own else False
        if isinstance(value, dict) and isinstance(self.kind, T.StructType):
            if not set(value) <= set(self.kind.names):
                return False
            return all_of(self.column.isNotNull(), *(self.field(n).equals(value[n]) if n in value else self.field(n).column.isNull() for n in self.kind.names))
        if isinstance(value, list) and isinstance(self.kind, T.ArrayType):
            return all_of(F.size(self.column) == len(value), *(self.item(F.get(self.column, F.lit(i))).equals(v) for i, v in enumerate(value)))
        return False

    def one_of(self, values) -> Predicate:
        own = self.names()
        plain = [v for v in values if not isinstance(v, bool) and (isinstance(v, str) and "string" in own and isinstance(self.kind, T.StringType) or isinstance(v, int | float) and "number" in own)]
        if self.column is not None and len(plain) > 1 and len(plain) == len(values):
            return self.column.isin(plain)
        return any_of(*(sure(self.equals(v)) for v in values))

    def sort_keys(self) -> list[Column]:
        return [self.column]


class Variant:
    """A VARIANT: every typed read stands behind a test of the value's own type, as reads of VARIANT convert."""

    def __init__(self, column: Column, element: bool = False, root: tuple[Column, str] | None = None):
        self.column, self.element = column, element
        #: The stored column and path below it, so that reads stay pushable to the scan.
        self.root = root or (column, "$")

    def _read(self, kind: str) -> Column:
        column, path = self.root
        return self.column if kind == "variant" and path == "$" else F.try_variant_get(column, path, kind)

    def names(self) -> frozenset[str]:
        return frozenset()

    def _of_kind(self, *kinds: str) -> Column:
        """Whether the value is stored as one of these; DECIMAL, ARRAY and OBJECT have parameters."""
        own = F.schema_of_variant(self.column)
        plain = [k for k in kinds if k not in ("DECIMAL", "ARRAY", "OBJECT")]
        tests = [own.isin(plain) if len(plain) > 1 else own == plain[0]] if plain else []
        return reduce(lambda a, b: a | b, [*tests, *(own.startswith(k) for k in kinds if k not in plain)])

    def exists(self) -> Predicate:
        return self.column.isNotNull()

    def present(self) -> Predicate:
        return self.column.isNotNull()

    def is_type(self, names: frozenset[str]) -> Predicate:
        kinds = {"array": ("ARRAY",), "boolean": ("BOOLEAN",), "null": ("VOID",), "object": ("OBJECT",), "string": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}
        wanted = [k for n in sorted(names) for k in kinds.get(n, ())]
        test: Predicate = self._of_kind(*wanted) if wanted else False
        if "integer" in names and "number" not in names:
            x = self._read("double")
            test = any_of(test, self._of_kind("BIGINT"), self._of_kind("DOUBLE", "FLOAT") & (x == F.floor(x)), self._of_kind("DECIMAL") & self._decimal_holds(lambda d: d == F.floor(d)))
        return test

    def field(self, name: str) -> Variant:
        column, path = self.root
        if "'" not in name and '"' not in name and "\\" not in name:
            path = f"{path}['{name}']"
            # Reading a path of a value that is no object gives null: the property is missing.
            return Variant(F.try_variant_get(column, path, "variant"), root=(column, path))
        return Variant(F.try_element_at(self._read("map<string,variant>"), F.lit(name)))

    def field_names(self) -> list[str]:
        return []

    def array(self) -> Column:
        return F.when(self.is_type(frozenset({"array"})), self._read("array<variant>"))

    def item(self, column: Column) -> Variant:
        return Variant(column, element=True)

    def size(self) -> Column:
        return F.size(self.array())

    def n_fields(self) -> Column:
        return F.size(F.map_keys(F.when(self.is_type(frozenset({"object"})), self._read("map<string,variant>"))))

    def number(self) -> Column:
        return self._read("double")

    def compare(self, test: str, x: int | float) -> Predicate:
        """Of a number, exactly: doubles decide, and where they are equal the value itself, as many numbers share one double.

        The comparison of doubles stands first and alone, so that it reaches the scan of a stored VARIANT.
        """
        d, near, outer = self.number(), _double(x), {">": ">=", "<": "<="}.get(test, test)
        double = TESTS[test](near, x)  # Python compares whole numbers and doubles exactly
        whole = TESTS[test](self._read("bigint"), F.lit(x)) if isinstance(x, int) and EXACT <= abs(x) < 1 << 63 else F.lit(TESTS[test](near, x))
        tie = F.when(self._of_kind("DECIMAL"), self._decimal_holds(lambda v: TESTS[test](v, F.lit(Decimal(str(x)))))).when(self._of_kind("BIGINT"), whole).otherwise(F.lit(double))
        rest = tie if test == "==" else (d != F.lit(near)) | tie
        return all_of(TESTS[outer](d, F.lit(near)), rest)

    def _decimal_holds(self, test: Callable[[Column], Column]) -> Column:
        """Decimals with more than 20 digits before the point count as whole numbers."""
        return F.coalesce(test(self._read("decimal(38,18)")), test(self._read("decimal(38,0)")))

    def decimal(self) -> Column:
        return self._read(DECIMAL)

    def text(self) -> Column:
        return self._read("string")

    def timestamp(self) -> Column:
        return Typed(self.text(), T.StringType()).timestamp()

    def search_text(self) -> tuple[Column, bool]:
        return F.to_json(self.column), True

    def equals(self, value) -> Predicate:
        if value is None:
            return F.is_variant_null(self.column)
        kind = "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string" if isinstance(value, str) else "object" if isinstance(value, dict) else "array"
        guard = self.is_type(frozenset({kind}))
        if kind == "boolean":
            return all_of(guard, self._read("boolean") == F.lit(value))
        if kind == "number":
            return all_of(guard, self.compare("==", value))
        if kind == "string":
            return all_of(guard, self.text() == F.lit(value))
        # Objects and arrays by canonical text: keys are sorted, numbers normalised.
        return all_of(guard, F.to_json(self.column) == F.to_json(F.parse_json(F.lit(json.dumps(value)))))

    def one_of(self, values) -> Predicate:
        return any_of(*(sure(self.equals(v)) for v in values))

    def sort_keys(self) -> list[Column]:
        """Object, array, boolean, number, string, null, in descending rank; then by number and by text."""
        rank = F.when(self.column.isNull(), None)
        for n, kinds in enumerate((("VOID",), ("STRING",), ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), ("BOOLEAN",), ("ARRAY",), ("OBJECT",))):
            rank = rank.when(self._of_kind(*kinds), n)
        number = F.when(self.is_type(frozenset({"number"})), self.number())
        return [rank, number, F.when(self.column.isNotNull(), self._read("string"))]


def value_of(column: Column, kind: T.DataType, element: bool = False) -> Typed | Variant:
    return Variant(column, element) if isinstance(kind, T.VariantType) else Typed(column, kind, element)


def _double(x: int | float) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.copysign(math.inf, x)


def decimal_literal(x) -> Column:
    return F.lit(Decimal(str(x))).cast(DECIMAL)
