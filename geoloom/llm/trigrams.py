"""Boolean trigram queries from regular expressions (driver-side planning).

``query(regex)`` returns a disjunction of trigram sets over case-folded text:
any text that the regex matches contains every trigram of at least one set.
``None`` means that the regex has no mandatory trigram.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

#: A run of literals stops growing at this many alternatives.
MAX_STRINGS = 64


def _fold(code: int) -> str:
    c = chr(code)
    return c.lower() if c.isascii() else c


def _class(items: list) -> set[str] | None:
    """The folded characters of a small class; None when it is large or negated."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(_fold(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {_fold(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _exact(seq) -> set[str] | None:
    """All strings that ``seq`` matches, or None if they are too many."""
    out = {""}
    for op, arg in seq:
        if op is sre.LITERAL:
            step = {_fold(arg)}
        elif op is sre.IN:
            step = _class(arg)
        elif op is sre.BRANCH:
            parts = [_exact(b) for b in arg[1]]
            step = None if None in parts else set().union(*parts)
        elif op is sre.SUBPATTERN:
            step = _exact(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            inner = _exact(arg[2])
            step = None if inner is None else inner | ({""} if arg[0] == 0 else set())
        elif op is sre.AT:
            step = {""}
        else:
            step = None
        if step is None or len(out) * len(step) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in step}
    return out


def _minimal(sets: set[frozenset[str]]) -> set[frozenset[str]]:
    return {s for s in sets if not any(o < s for o in sets)}


def _both(a: set[frozenset[str]] | None, b: set[frozenset[str]] | None):
    if a is None or b is None:
        return b if a is None else a
    both = _minimal({x | y for x in a for y in b})
    return both if len(both) <= MAX_STRINGS else a


def _of_strings(strings: set[str]) -> set[frozenset[str]] | None:
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in sets else _minimal(sets)


def _walk(seq) -> set[frozenset[str]] | None:
    found, run = None, {""}
    for item in seq:
        step = _exact([item])
        if step is not None and len(run) * len(step) <= MAX_STRINGS:
            run = {a + b for a in run for b in step}
            continue
        found, run = _both(found, _of_strings(run)), {""}
        op, arg = item
        if step is not None:
            run = step
        elif op is sre.SUBPATTERN:
            found = _both(found, _walk(arg[3]))
        elif op is sre.BRANCH:
            parts = [_walk(b) for b in arg[1]]
            if None not in parts:
                found = _both(found, _minimal(set().union(*parts)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            found = _both(found, _walk(list(arg[2]) * min(arg[0], 4)))
    return _both(found, _of_strings(run))


def query(regex: str) -> list[frozenset[str]] | None:
    sets = _walk(list(parser.parse(regex)))
    return None if sets is None else sorted(sets, key=sorted)
