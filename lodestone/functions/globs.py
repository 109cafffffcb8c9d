"""File patterns as regular expressions, in the three dialects that the configuration files use."""

from __future__ import annotations

import re

_PLAIN = re.compile(r"[A-Za-z0-9_/ -]")


def _quoted(c: str) -> str:
    return c if _PLAIN.fullmatch(c) or not c.isascii() else f"\\{c}"


def strict(glob: str) -> str:
    """``**`` is anything, ``*`` and ``?`` stay within a folder; case does not count. A bracket is an error."""
    if "[" in glob:
        raise ValueError(f"brackets are not supported: {glob}")
    out, i, g = [], 0, glob.replace("\\", "/")
    while i < len(g):
        if g[i] == "*":
            two = g[i : i + 2] == "**"
            out.append(".*" if two else "[^/]*")
            i += 1 + two
        else:
            out.append("[^/]" if g[i] == "?" else _quoted(g[i]))
            i += 1
    return f"(?i)^{''.join(out)}$"


def loose(glob: str) -> str:
    """``*`` and ``?`` cross folders; used for suppressions, services, stale files and literals."""
    body = "".join(".*" if c == "*" else "." if c == "?" else _quoted(c) for c in re.sub(r"\*+", "*", glob.replace("\\", "/")))
    return f"(?i)^{body}$"


def ignored(patterns: list[str]) -> str:
    """One expression for the paths that lines of an ignore file exclude; comments, blank lines and negations do not count.

    A pattern that ends in a slash excludes a folder anywhere, one with wildcards is held against the
    whole path with ``*`` crossing folders, and any other is the end of a path or one of its parts.
    """
    out = []
    for line in patterns:
        p = line.strip().replace("\\", "/").lstrip("/")
        if not p or p[0] in "#!":
            continue
        body = "".join(".*" if c == "*" else "." if c == "?" else _quoted(c) for c in p.rstrip("/"))
        if p.endswith("/"):
            out.append(f"(^|.*/){body}/.*")
        elif "*" in p or "?" in p:
            out.append(body)
        else:
            out.append(f".*{body}|(^|.*/){body}(/.*)?")
    return f"(?i)^({'|'.join(out)})$" if out else "(?!)"
