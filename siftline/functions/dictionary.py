"""Phrases of a dictionary found in one pass over a text, whatever their number.

The phrases become one pattern that shares their beginnings (a tree of characters), so a position of the text is given up
at the first character that begins no phrase. At every word start the longest phrase is captured without being consumed, so phrases that
overlap are all seen; a map from phrase to codes, in which a phrase also stands for those that it begins with, turns what was captured into
codes. Two or two hundred phrases read the text once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

#: Case and word characters by Unicode; not inside a word.
START = r"(?iuU)(?<!\w)"


#: The same for texts in lower case in which all that fits is spelled as it is: no case, and starts of ASCII words, which are more.
PLAIN_START = "(?<![a-z0-9_])"


def _escaped(c: str) -> str:
    return c if c.isalnum() or c == " " else "\\" + c


def tree_pattern(phrases: Iterable[str]) -> str:
    """A pattern for the phrases that shares their beginnings; it takes the longest at a place."""
    tree: dict = {}
    for phrase in sorted(set(phrases)):
        node = tree
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [_escaped(c) + written(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return body + "?" if "" in node else body

    return written(tree)


def mentions(phrases: Iterable[str], start: str = START) -> str:
    """A pattern for `rlike`: some phrase at the start of a word."""
    return start + tree_pattern(phrases)


def codes_in(text: Column, names: Mapping[str, Iterable[str]]) -> Column:
    """The sorted codes whose phrases begin at a word start of the text; null for null. names: code to lower-case phrases."""
    of: dict[str, set[str]] = {}
    for code, phrases in names.items():
        for p in phrases:
            of.setdefault(p, set()).add(code)
    whole = {p: sorted({c for q, codes in of.items() if p.startswith(q) for c in codes}) for p in of}
    table = F.create_map(*[x for p, codes in whole.items() for x in (F.lit(p), F.array(*[F.lit(c) for c in codes]))])
    found = F.regexp_extract_all(text, F.lit(START + "(?=(" + tree_pattern(of) + "))"), F.lit(1))
    # what case folding lets match: the long s is no capital's small letter
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform(found, lambda x: F.translate(F.lower(x), "ſ", "s"))), lambda x: table[x]))))
