"""Rewriting predicates: normal form, weakening, what they pin."""

from __future__ import annotations

from collections.abc import Collection, Iterable

from .expr import FALSE, TRUE, And, Between, Cmp, Expr, Field, InSet, InTuples, IsNull, Lit, Not, Or, all_of, any_of

_OPPOSITE = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def split_and(p: Expr) -> list[Expr]:
    return split_and(p.left) + split_and(p.right) if isinstance(p, And) else [p]


def split_or(p: Expr) -> list[Expr]:
    return split_or(p.left) + split_or(p.right) if isinstance(p, Or) else [p]


def nnf(p: Expr, ask: str = "true") -> Expr:
    """True of the same rows, with negations only at atoms, where a predicate may be weakened safely.

    ask: what is asked of p: that it is `true`, `false`, `not true` or `not false`. The
    first and the last differ from their opposites by rows on which p is unknown; SQL's
    NOT swaps true and false, the two-valued one turns true into not true.
    """
    if isinstance(p, Not):
        if p.two_valued:
            return nnf(p.arg, "not true" if ask in ("true", "not false") else "true")
        return nnf(p.arg, {"true": "false", "false": "true", "not true": "not false", "not false": "not true"}[ask])
    if isinstance(p, (And, Or)):
        kind = type(p) if ask in ("true", "not false") else (Or if isinstance(p, And) else And)
        return kind(nnf(p.left, ask), nnf(p.right, ask))
    if isinstance(p, Between):
        return nnf(p._expanded(), ask)
    if isinstance(p, Lit):
        v = p.value
        return Lit({"true": v is True, "false": v is False, "not true": v is not True, "not false": v is not False}[ask])
    if ask == "true":
        return p
    if ask == "not true":
        return Not(p, True)
    opposite = Cmp(_OPPOSITE[p.op], p.left, p.right) if isinstance(p, Cmp) and p.op in _OPPOSITE else Not(p)
    return opposite if ask == "false" else Not(opposite, True)


def simplify(p: Expr) -> Expr:
    """Without constants that decide nothing, and without repeated conjuncts or disjuncts."""
    if isinstance(p, And):
        parts = _distinct(q for x in split_and(p) for q in split_and(simplify(x)))
        if any(_is(x, False) for x in parts):
            return FALSE
        return all_of(x for x in parts if not _is(x, True))
    if isinstance(p, Or):
        parts = _distinct(q for x in split_or(p) for q in split_or(simplify(x)))
        if any(_is(x, True) for x in parts):
            return TRUE
        return any_of(x for x in parts if not _is(x, False))
    return p


def _is(p: Expr, value: bool) -> bool:
    return isinstance(p, Lit) and p.value is value


def _distinct(parts: Iterable[Expr]) -> list[Expr]:
    return list({repr(p): p for p in parts}.values())


def weaken(p: Expr, gone: Collection[str]) -> Expr:
    """Implied by p and free of the columns that are gone: their atoms count as true.

    Rows of a tuple list keep the columns that remain, still compared together.
    """
    gone = set(gone)

    def walk(q: Expr) -> Expr:
        if isinstance(q, (And, Or)):
            return type(q)(walk(q.left), walk(q.right))
        if not q.columns() & gone:
            return q
        if isinstance(q, InTuples):
            keep = [i for i, a in enumerate(q.args) if not a.columns() & gone]
            if keep:
                return InTuples(tuple(q.args[i] for i in keep), tuple(dict.fromkeys(tuple(r[i] for i in keep) for r in q.rows)))
        return TRUE

    return simplify(walk(nnf(p)))


def pinned(p: Expr, one: bool = False) -> frozenset[str]:
    """Columns that p fixes: to one value by a conjunct, or together to the rows of one tuple list.

    one: only columns with one value that isn't null.
    """
    single, together = set(), set()
    for q in split_and(nnf(p)):
        if isinstance(q, Cmp) and q.op in ("==", "<=>"):
            for a, b in ((q.left, q.right), (q.right, q.left)):
                if isinstance(a, Field) and isinstance(b, Lit) and (not one or b.value is not None):
                    single.add(a.name)
        elif not one and isinstance(q, IsNull) and isinstance(q.arg, Field):
            single.add(q.arg.name)
        elif isinstance(q, InSet) and isinstance(q.arg, Field) and len(q.values) == 1:
            single.add(q.arg.name)
        elif isinstance(q, InTuples) and all(isinstance(a, Field) for a in q.args) and not together and (not one or (len(q.rows) == 1 and None not in q.rows[0])):
            together |= {a.name for a in q.args}
    return frozenset(single | together)


def implied_pins(p: Expr, pairs: Iterable[tuple[str, str]]) -> Expr:
    """The atoms that p has on one column of each pair, on the other one: keys carried over a join."""
    out = []
    for q in split_and(nnf(p)):
        for a, b in pairs:
            if q.columns() == {a} and not isinstance(q, IsNull):
                out.append(q.substitute({a: Field(b)}))
            elif q.columns() == {b} and not isinstance(q, IsNull):
                out.append(q.substitute({b: Field(a)}))
    return all_of(out)
