"""Boolean trigram queries that any text with a match of a regular expression must satisfy."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

#: Strings that are kept apart while reading an expression; beyond, they are turned into a condition.
MOST_STRINGS = 128
#: Characters of a class that are told apart.
MOST_CHARS = 8

#: A query is an OR of conjunctions of lower-case trigrams. The empty conjunction holds for every text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _absorb(q: set[frozenset[str]]) -> Query:
    return frozenset(c for c in q if not any(d < c for d in q))


def _and(a: Query, b: Query) -> Query:
    return _absorb({c | d for c in a for d in b}) if len(a) * len(b) <= 4 * MOST_STRINGS else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    return _absorb({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _chars(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 4 * MOST_CHARS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARS else None


def _read(items, strings: set[str], query: Query) -> tuple[set[str], Query]:
    """strings: what may stand directly before; query: what must hold already."""
    for op, arg in items:
        options: set[str] | None = None
        if op is sre.LITERAL:
            options = {chr(arg).lower()}
        elif op is sre.IN:
            options = _chars(arg)
        elif op is sre.AT:
            options = {""}
        elif op is sre.SUBPATTERN:
            strings, query = _read(arg[-1], strings, query)
            continue
        elif op is sre.BRANCH:
            found = [_read(b, {""}, ANY) for b in arg[1]]
            if all(q == ANY for _, q in found):
                options = set().union(*(s for s, _ in found))
            else:
                query = _and(_and(query, _of_strings(strings)), _absorb(set().union(*(_and(q, _of_strings(s)) for s, q in found))))
                strings = {""}
                continue
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, body = arg
            s, q = _read(body, {""}, ANY)
            if q == ANY and most == 1:
                options = s | {""} if least == 0 else s
            else:
                for _ in range(min(least, 3)):
                    strings, query = _read(body, strings, query)
                if most == least <= 3:
                    continue
        if options is None or len(strings) * len(options) > MOST_STRINGS:
            query, strings = _and(query, _of_strings(strings)), options if options is not None else {""}
        else:
            strings = {a + b for a in strings for b in options}
    return strings, query


def trigram_query(pattern: str) -> Query:
    """The query of a pattern, ANY if no trigram is mandatory. Sound for texts that are lower-cased letter by letter."""
    strings, query = _read(parser.parse(pattern), {""}, ANY)
    return _and(query, _of_strings(strings))
