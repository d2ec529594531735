"""From a schema and a value to a predicate. Every keyword but the logical ones leaves values of other types alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.formats import FORMATS
from ..functions.predicates import Predicate, all_of, any_of, column, implies, negation, sure
from ..functions.values import Typed, Variant, decimal_literal
from .schema import Schema

Value = Typed | Variant
NUMBER, STRING, ARRAY, OBJECT = (frozenset({x}) for x in ("number", "string", "array", "object"))
NUMERIC = frozenset({"number", "integer"})


class Compiler:
    """link(verb, schema, inside_element) gives the predicate of a link of the root document."""

    def __init__(self, link: Callable[[str, Schema, bool], Predicate]):
        self.link = link

    def predicate(self, s: Schema, v: Value, inside: bool = False) -> Predicate:
        """For a value that exists; NULL rejects."""
        if s.always is not None:
            return s.always
        typed = [v.is_type(s.types)] if s.types else []
        parts: list[Predicate] = [*typed]
        for word, x in s.words.items():
            method = getattr(self, "_" + word.replace("$$", ""), None)
            if method is not None:
                parts.append(method(x, v, s, inside))
        return all_of(*parts)

    def _guarded(self, v: Value, s: Schema, names: frozenset[str], p: Predicate) -> Predicate:
        """p for values of these types; without a guard where `type` allows no other."""
        allowed = s.types
        if allowed and allowed <= (NUMERIC if names == NUMBER else names):
            return p
        held = v.is_type(names)
        return implies(held, p) if held is not False else True

    # Any type.

    def _const(self, x, v, s, inside):
        return v.equals(x)

    def _enum(self, x, v, s, inside):
        return v.one_of(x)

    # Numbers.

    def _compare(self, v, s, test):
        return self._guarded(v, s, NUMBER, test()) if self._may(v, NUMBER) else True

    def _may(self, v: Value, names: frozenset[str]) -> bool:
        return isinstance(v, Variant) or bool(v.names() & names)

    def _minimum(self, x, v, s, inside):
        return self._compare(v, s, lambda: v.compare(">=", x))

    def _maximum(self, x, v, s, inside):
        return self._compare(v, s, lambda: v.compare("<=", x))

    def _exclusiveMinimum(self, x, v, s, inside):
        return self._compare(v, s, lambda: v.compare(">", x))

    def _exclusiveMaximum(self, x, v, s, inside):
        return self._compare(v, s, lambda: v.compare("<", x))

    def _multipleOf(self, x, v, s, inside):
        # In decimals: 2.5 is a multiple of 0.1, though not as doubles.
        return self._compare(v, s, lambda: v.decimal() % decimal_literal(x) == 0)

    # Strings.

    def _string(self, v, s, test):
        return self._guarded(v, s, STRING, test()) if self._may(v, STRING) else True

    def _minLength(self, x, v, s, inside):
        return self._string(v, s, lambda: F.length(v.text()) >= x)

    def _maxLength(self, x, v, s, inside):
        return self._string(v, s, lambda: F.length(v.text()) <= x)

    def _pattern(self, x, v, s, inside):
        return self._string(v, s, lambda: v.text().rlike(x))

    _regexp = _pattern

    def _format(self, x, v, s, inside):
        if isinstance(v, Typed) and isinstance(v.kind, T.TimestampType | T.TimestampNTZType):
            return x == "date-time"
        return self._string(v, s, lambda: v.text().rlike(FORMATS[x]))

    def _formatMinimum(self, x, v, s, inside):
        return self._format_limit(x, v, s, lambda a, b: a >= b)

    def _formatMaximum(self, x, v, s, inside):
        return self._format_limit(x, v, s, lambda a, b: a <= b)

    def _format_limit(self, x, v, s, test):
        if s.get("format") == "time":
            plain = lambda c: F.regexp_extract(c, r"^[0-9:.]+", 0)
            return self._string(v, s, lambda: test(plain(v.text()), plain(F.lit(x))))
        return self._string(v, s, lambda: test(v.timestamp(), Typed(F.lit(x), T.StringType()).timestamp()))

    def _fullTextSearch(self, term, v, s, inside):
        if term is None:
            return True
        if isinstance(v, Typed) and v.stems() is not None:
            return text.stored_match(v.stems(), term)
        body, is_json = v.search_text()
        if inside:  # no Python in lambdas: an element's text is matched outside
            raise NotImplementedError("fullTextSearch inside array elements is taken by contains")
        return text.matches(body, term, is_json)

    # Objects.

    def _required(self, names, v, s, inside):
        if not self._may(v, OBJECT):
            return True
        done = s.get("properties", {})
        return self._guarded(v, s, OBJECT, all_of(*(v.field(n).exists() for n in names if n not in done)))

    def _properties(self, x, v, s, inside):
        if not self._may(v, OBJECT):
            return True
        required, parts = set(s.get("required", ())), []
        for name, sub in x.items():
            f = v.field(name)
            there = f.exists()
            if sub.always is False:
                parts.append(negation(there))
                if name in required:
                    parts.append(False)
                continue
            p = self.predicate(sub, f, inside)
            parts.append(all_of(there, p) if name in required else implies(there, p))
        return self._guarded(v, s, OBJECT, all_of(*parts))

    def _minProperties(self, x, v, s, inside):
        return self._guarded(v, s, OBJECT, v.n_fields() >= x) if self._may(v, OBJECT) else True

    def _maxProperties(self, x, v, s, inside):
        return self._guarded(v, s, OBJECT, v.n_fields() <= x) if self._may(v, OBJECT) else True

    # Arrays.

    def _minItems(self, x, v, s, inside):
        return self._guarded(v, s, ARRAY, v.size() >= x) if self._may(v, ARRAY) else True

    def _maxItems(self, x, v, s, inside):
        return self._guarded(v, s, ARRAY, v.size() <= x) if self._may(v, ARRAY) else True

    def _items(self, x, v, s, inside):
        if not self._may(v, ARRAY):
            return True
        array = v.array()
        if isinstance(x, tuple):
            parts = [implies(F.size(array) > i, self.predicate(sub, v.item(F.get(array, F.lit(i))), inside)) for i, sub in enumerate(x)]
            if s.get("additionalProperties") is False:
                parts.append(F.size(array) <= len(x))
            return self._guarded(v, s, ARRAY, all_of(*parts))
        each = lambda e: column(sure(self.predicate(x, v.item(e), True)))
        return self._guarded(v, s, ARRAY, F.forall(array, each))

    def _contains(self, x, v, s, inside):
        if not self._may(v, ARRAY):
            return True
        array = v.array()
        if "fullTextSearch" in x.words and x.get("fullTextSearch") is not None and not inside:
            body, is_json = v.search_text()
            found = text.matches(body, x.words["fullTextSearch"], is_json)
            rest = Schema(None, {k: y for k, y in x.words.items() if k != "fullTextSearch"}, x.path)
            return self._guarded(v, s, ARRAY, all_of(found, F.exists(array, lambda e: column(sure(self.predicate(rest, v.item(e), True))))))
        if set(x.words) == {"const"} and isinstance(v, Typed) and not isinstance(x.words["const"], dict | list) and x.words["const"] is not None:
            const = x.words["const"]
            fits = v.item(F.lit(None)).equals(const)
            return self._guarded(v, s, ARRAY, F.array_contains(array, F.lit(const)) if fits is not False else False)
        return self._guarded(v, s, ARRAY, F.exists(array, lambda e: column(sure(self.predicate(x, v.item(e), True)))))

    # Logic.

    def _allOf(self, x, v, s, inside):
        return all_of(*(self.predicate(sub, v, inside) for sub in x))

    def _anyOf(self, x, v, s, inside):
        return any_of(*(self.predicate(sub, v, inside) for sub in x))

    def _oneOf(self, x, v, s, inside):
        total = F.lit(0)
        for sub in x:
            total = total + column(sure(self.predicate(sub, v, inside))).cast("int")
        return total == 1

    def _not(self, x, v, s, inside):
        return negation(self.predicate(x, v, inside))

    def _if(self, x, v, s, inside):
        test = sure(self.predicate(x, v, inside))
        yes = self.predicate(s.get("then", Schema(True)), v, inside)
        no = self.predicate(s.get("else", Schema(True)), v, inside)
        if isinstance(test, bool):
            return yes if test else no
        return F.when(test, column(yes)).otherwise(column(no))

    def _links(self, x, v, s, inside):
        return all_of(*(self.link(verb, sub, inside) for verb, sub in x.items()))
