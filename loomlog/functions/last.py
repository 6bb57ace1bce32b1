"""``LAST(x)`` in SQL text: the value at the greatest offset, or by an ORDER BY of its own."""

from __future__ import annotations

import re

_SKIP = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/""", re.DOTALL)
_CALL = re.compile(r"(?<![\w.])last\s*\(", re.IGNORECASE)


def _close(sql: str, at: int) -> int:
    """Where the parenthesis before ``at`` is closed; quoted text doesn't count."""
    depth = 1
    while at < len(sql):
        if m := _SKIP.match(sql, at):
            at = m.end()
            continue
        depth += (sql[at] == "(") - (sql[at] == ")")
        if not depth:
            return at
        at += 1
    raise ValueError("LAST( is not closed")


def _top_level(text: str, pattern: re.Pattern) -> list[re.Match]:
    out, at, depth = [], 0, 0
    while at < len(text):
        if m := _SKIP.match(text, at):
            at = m.end()
            continue
        if not depth and (m := pattern.match(text, at)):
            out.append(m)
            at = m.end()
            continue
        depth += (text[at] == "(") - (text[at] == ")")
        at += 1
    return out


_ORDER = re.compile(r"(?<!\w)order\s+by(?!\w)", re.IGNORECASE)
_COMMA = re.compile(",")
_WAY = re.compile(r"\s+(asc|desc)\s*$", re.IGNORECASE)


def rewrite_last(sql: str, order: str = "_offset") -> str:
    """``LAST(x)`` becomes ``max_by(x, _offset)``, ``LAST(x ORDER BY y [DESC])`` the value at the greatest (least) y.

    Nulls are values. Several keys of one direction are compared in turn. Quoted text and comments stay as they are.
    """
    out, at = [], 0
    while at < len(sql):
        if m := _SKIP.match(sql, at):
            out.append(m[0])
            at = m.end()
        elif (m := _CALL.match(sql, at)) and not (at and (sql[at - 1].isalnum() or sql[at - 1] in "_.")):
            end = _close(sql, m.end())
            inner = rewrite_last(sql[m.end() : end], order)
            found = _top_level(inner, _ORDER)
            if not found:
                out.append(f"max_by({inner.strip()}, {order})")
            else:
                value, keys = inner[: found[-1].start()].strip(), inner[found[-1].end() :]
                cuts = [-1, *(c.start() for c in _top_level(keys, _COMMA)), len(keys)]
                parts = [keys[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:], strict=False)]
                ways = {(w[1].lower() if (w := _WAY.search(p)) else "asc") for p in parts}
                if len(ways) > 1:
                    raise ValueError("LAST takes keys of one direction")
                parts = [_WAY.sub("", p) for p in parts]
                key = parts[0] if len(parts) == 1 else f"struct({', '.join(parts)})"
                out.append(f"{'min_by' if ways == {'desc'} else 'max_by'}({value}, {key})")
            at = end + 1
        else:
            out.append(sql[at])
            at += 1
    return "".join(out)
