"""Lists of globs as one pattern that holds them as a prefix tree, compiled and checked before any row is read."""

from __future__ import annotations

import re
from itertools import groupby

#: Characters that stand for themselves only when escaped.
_SPECIAL = set(r"\.[](){}+^|$&~-#")


def pieces(glob: str, literal: bool = True) -> list[str]:
    """A glob as pieces of a pattern: ``*`` any text, ``?`` any character, all others stand for themselves.

    Without ``literal`` other characters keep the meaning that patterns give them, as some tools have it; a glob that is
    no valid pattern then raises ValueError here and not in a task.
    """
    if not literal:
        body = glob.replace("*", ".*").replace("?", ".")
        try:
            re.compile(body)
        except re.error as e:
            raise ValueError(f"glob {glob!r} is no valid pattern: {e}") from None
        return [f"(?:{body})"]
    kind = {"*": ".*", "?": "."}
    return [kind.get(c, "\\" + c if c in _SPECIAL else c) for c in re.sub(r"\*+", "*", glob)]


#: How far beginnings are nested: both pattern compilers recurse.
DEEPEST = 50


def _tree(lists: list[list[str]], at: int, depth: int = 0) -> str:
    """Sorted lists that agree before ``at``, with their common beginnings written once."""
    if depth == DEEPEST:
        return f"(?:{'|'.join(''.join(x[at:]) for x in lists)})"
    out = []
    for first, group in groupby(lists, lambda x: x[at] if at < len(x) else None):
        same = list(group)
        if first is None:
            out.append("")
            continue
        to = at + 1
        while to < min(map(len, same)) and all(x[to] == same[0][to] for x in same):
            to += 1
        out.append("".join(same[0][at:to]) + (_tree(same, to, depth + 1) if any(len(x) > to for x in same) else ""))
    return out[0] if len(out) == 1 else "(?:" + "|".join(out) + ")"


def pattern(globs: list[str], literal: bool = True) -> str:
    """One anchored pattern for all of ``globs``: a text is matched in one pass, however many there are."""
    lists = sorted({tuple(pieces(g, literal)) for g in globs})
    return rf"(?s)\A(?:{_tree([list(x) for x in lists], 0)})\z"
