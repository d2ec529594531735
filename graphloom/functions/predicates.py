"""Boolean algebra over Columns and Python booleans, folded while the plan is built.

A Column may be NULL, which rejects like false; only under a negation is it made false first, so that positive
predicates stay as they are and reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Column | bool


def column(p: Predicate) -> Column:
    return F.lit(p) if isinstance(p, bool) else p


def sure(p: Predicate) -> Predicate:
    """Never NULL."""
    return p if isinstance(p, bool) else F.coalesce(p, F.lit(False))


def all_of(*ps: Predicate) -> Predicate:
    ps = [p for p in ps if p is not True]
    if any(p is False for p in ps):
        return False
    return reduce(lambda a, b: a & b, ps) if ps else True


def any_of(*ps: Predicate) -> Predicate:
    ps = [p for p in ps if p is not False]
    if any(p is True for p in ps):
        return True
    return reduce(lambda a, b: a | b, ps) if ps else False


def negation(p: Predicate) -> Predicate:
    return not p if isinstance(p, bool) else ~sure(p)


def implies(a: Predicate, b: Predicate) -> Predicate:
    if a is True or b is True:
        return b
    if a is False:
        return True
    return any_of(negation(a), b)
