"""Many patterns over one text, without a regular expression for each.

A text's words are split once; a pattern that is a whole word asks the set of those that any pattern names.  Patterns without special characters
are looked for as plain text.  What is left stays a regular expression, behind a look for the plain text that every match of it holds.
Patterns are searched without regard to the case of A-Z; letters, digits, marks and ``_`` of any script are of words, and a dot stops at line
feeds only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found

NON_WORD = r"[^\p{L}\p{Nd}\p{Mn}_]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"\\b(\w+?)(s\?)?\\b")
_PLAIN = re.compile(r"[\w <>×⊕]+")
_CLASS = re.compile(r"\[((?:\\\W|[^]\\\w^-])+)\]")
#: What matches no text of its own, any of several, or perhaps none: groups, classes, escapes of letters, repetitions.
_SPECIAL = re.compile(r"\(\?[:!=<][^)]*\)\??|\[[^]]*\][?*]?|\\[a-zA-Z][?*]?|\{[^}]*\}|(?:\\\W|[^\\])[?*]|(?<!\\)[.+^$()]")


def alternatives(pattern: str) -> list[str]:
    """What stands between the bars outside brackets."""
    depth, parts, at = 0, [""], 0
    while at < len(pattern):
        c = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        depth += (c in ("(", "[")) - (c in (")", "]"))
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
        at += len(c)
    return parts


def whole_words(pattern: str) -> list[str]:
    """The words that an alternative consists of; none where it is of another kind."""
    m = _WORD.fullmatch(pattern)
    return [] if not m else [m[1].lower(), *([m[1].lower() + "s"] if m[2] else [])]


def held(pattern: str) -> list[str]:
    """Plain texts that every match of an alternative holds, in lower case."""
    return [p.replace("\\", "").lower() for p in _SPECIAL.sub("\0", pattern).split("\0") if p.strip()]


def vocabulary(patterns: Iterable[str]) -> list[str]:
    return sorted({w for p in patterns for a in alternatives(p) for w in whole_words(a)})


def fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words_of(folded: Column, patterns: Iterable[str]) -> Column:
    """Of the words that the patterns name, those of a text."""
    return F.array_intersect(F.array(*map(F.lit, vocabulary(patterns))), F.split(folded, NON_WORD))


def occurs(folded: Column, words: Column, pattern: str) -> Column:
    """Does the pattern occur in a text, given in lower case and by the words that ``words_of`` names?"""
    tests, left, gates = [], [], []
    for a in alternatives(pattern):
        if whole_words(a):
            tests += [F.array_contains(words, w) for w in whole_words(a)]
        elif _PLAIN.fullmatch(a):
            tests.append(F.contains(folded, F.lit(a.lower())))
        elif m := _CLASS.fullmatch(a):
            tests += [F.contains(folded, F.lit(c)) for c in m[1].replace("\\", "")]
        else:
            left.append(a)
            gates.append(reduce(and_, (F.contains(folded, F.lit(h)) for h in held(a)), F.lit(True)))
    if left:
        tests.append(reduce(or_, gates) & found(folded, "|".join(left)))
    return reduce(or_, tests)


def linear(pattern: str) -> str:
    """An alternative that occurs where the given one does, and whose search doesn't go over a text again from each place.

    Of a repetition at either end what must be there is enough.  Plain parts with ``.*`` between them are looked for once in each line, the
    first of each behind the first of the one before.
    """
    parts = pattern.split(".*")
    if len(parts) > 1 and all(re.fullmatch(r"[\w ]+|\[\w+\]", p) for p in parts):
        return "(?m)^" + "".join(f"(?>.*?{p})" for p in parts)
    return re.sub(r"^(\[[^]]*\]\{\d+),\}|(?<=[*+ ])(\[[^]]*\]\{\d+),\}$", lambda m: (m[1] or m[2]) + "}", pattern)


def occurs_in(text: Column, lowered: Column, pattern: str) -> Column:
    """Does the pattern occur in a text?  Each alternative is looked for behind a look for its plain texts in the text in lower case."""
    return reduce(or_, (reduce(and_, [*(F.contains(lowered, F.lit(h)) for h in held(a)), found(text, linear(a))]) for a in alternatives(pattern)))
