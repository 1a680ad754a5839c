"""Expressions and predicates that compile to Spark columns and can be pushed backwards."""

from .expr import (
    And, Arith, Between, Call, Case, Cast, Cmp, Contains, Expr, Field, InSet, InTuples, IsNull, Like, Lit, Not, Opaque, Or, TRUE, FALSE,
    all_of, any_of, col, lit, row_predicate,
)
from .fold import truth
from .generate import random_predicate, schema_predicate
from .implication import explicit, implies, satisfiable
from .rewrite import implied_pins, nnf, pinned, simplify, split_and, split_or, weaken

__all__ = [
    "And", "Arith", "Between", "Call", "Case", "Cast", "Cmp", "Contains", "Expr", "Field", "InSet", "InTuples", "IsNull", "Like", "Lit", "Not", "Opaque", "Or", "TRUE", "FALSE",
    "all_of", "any_of", "col", "explicit", "implies", "lit", "row_predicate", "satisfiable", "implied_pins", "nnf", "pinned", "random_predicate", "schema_predicate", "simplify", "split_and", "split_or", "truth", "weaken",
]
