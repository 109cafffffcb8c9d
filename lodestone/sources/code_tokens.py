"""Literals of C# and PowerShell files with what they are an argument of, read in one pass over a whole file.

A file is one row and its tokens are rows, made in tasks a batch of files at a time; what is done with the
literals is left to expressions. The scanners know strings of every kind, comments and brackets over any
number of lines; they keep a stack of what is open, so the work grows with the file's length alone.

Defined results: a null or empty text has no tokens; what is never closed ends with the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CSHARP = "kind string, line int, column int, value string, symbol string, attribute string, calls array<string>, made boolean, content string, near_config boolean, spared array<string>"
POWERSHELL = "line int, column int, value string, command string, parameter string, words array<string>, content string, spared array<string>"

_SIGN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?:\$+@?|@\$?)?\"|'(?:\\.[^'\n]*|[^'\\\n])'|[A-Za-z_@][\w.]*(?:\s*<[\w\s.,<>\[\]?]*>(?=\s*[({\[]))?|(?<![\w.])[0-9][\w.]*|[()\[\]{};,]|=>|[^\s\w]", re.S)


_QUOTES = re.compile('"+')


class _Places:
    """Lines and columns of a text by offset."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.lines = [x.removesuffix("\r") for x in text.split("\n")]

    def of(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1


def _quoted_end(text: str, at: int, verbatim: bool, holes: bool) -> int:
    """Behind the closing quote of a string whose first character is at ``at``; expressions in holes may hold strings of their own."""
    depth = 0
    while at < len(text):
        c = text[at]
        if holes and c in "{}" and not depth and text[at + 1 : at + 2] == c:
            at += 2
        elif holes and c == "{":
            depth, at = depth + 1, at + 1
        elif depth and c == "}":
            depth, at = depth - 1, at + 1
        elif depth and c == '"':
            at = _quoted_end(text, at + 1, False, False)
        elif depth:
            at += 1
        elif c == "\\" and not verbatim:
            at += 2
        elif c == '"':
            if not (verbatim and text[at + 1 : at + 2] == '"'):
                return at + 1
            at += 2
        elif c == "\n" and not verbatim:
            return at
        else:
            at += 1
    return len(text)


def _string(text: str, start: int, quote: int) -> tuple[int, str]:
    """``(end, value)`` of the C# string whose prefix begins at ``start`` and whose quotes begin at ``quote``."""
    prefix, raw = text[start:quote], _QUOTES.match(text, quote).end() - quote
    if raw >= 3:
        end = text.find('"' * raw, quote + raw)
        end = len(text) if end < 0 else end
        return min(end + raw, len(text)), text[quote + raw : end].strip("\r\n")
    end = _quoted_end(text, quote + 1, "@" in prefix, "$" in prefix)
    inner = text[quote + 1 : end - 1] if text[end - 1 : end] == '"' and end - 1 > quote else text[quote + 1 : end]
    return end, inner.replace('""', '"') if "@" in prefix else re.sub(r"\\(.)", r"\1", inner)


def csharp(text: str, config_reads: tuple[str, ...], marker: str) -> list[tuple]:
    """Rows of ``CSHARP``: strings, whole numbers and objects made, with the calls open around them from the innermost outward."""
    places, out, stack = _Places(text), [], []
    reads = [n for n, x in enumerate(places.lines, 1) if any(t in x for t in config_reads)]
    marks: dict[int, str] = {}
    name, made, before = "", False, "{"
    at = 0
    while m := _SIGN.search(text, at):
        t, start, at = m[0], m.start(), m.end()
        if t.startswith(("//", "/*")):
            if told := re.search(rf"(?i){marker}:\s*ignore\s+([a-z0-9.-]+)", t):
                marks[places.of(start)[0]] = told[1].lower()
            continue
        if t.endswith('"') and not t.startswith("'"):
            at, value = _string(text, start, m.end() - 1)
            out.append(("string", start, value, list(stack)))
            name, made = "", False
        elif t[0].isdigit():
            if t.isdigit() and len(t) < 10:
                out.append(("number", start, t, list(stack)))
            name, made = "", False
        elif t[0].isalpha() or t[0] in "_@":
            word = re.sub(r"\s*<.*", "", t, flags=re.S)
            if before == "." and name:  # a name that goes on behind blanks
                word = f"{name}.{word}"
                if made:
                    out[-1] = (*out[-1][:2], word, out[-1][3])
            else:
                made = before == "new"
                if made:
                    out.append(("new", start, word, list(stack)))
            name = "" if word in ("new", "return", "if", "while", "switch", "for", "foreach", "using", "lock", "catch") else word
            t = word
        elif t in "([{":
            section = t == "[" and before in ("{", "}", ";", "]", "[") or (t == "[" and before == "(" and not name)
            stack.append((t, name, made, section))
            name, made = "", False
        elif t in ")]}":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == {")": "(", "]": "[", "}": "{"}[t]:
                    del stack[k:]
                    break
            name, made = "", False
        elif t != ".":
            name, made = "", False
        before = t
    rows = []
    for kind, start, value, open_ in out:
        line, column = places.of(start)
        calls, attribute, symbol, new = [], None, None, False
        for bracket, n, was_made, section in reversed(open_):
            if bracket == "{":
                break
            if section:
                attribute = calls[-1] if calls else ""
                break
            if n:
                calls.append(("new " if was_made else "") + n)
        if calls:
            new, symbol = calls[0].startswith("new "), calls[0].removeprefix("new ")
        near = bool(reads) and any(abs(r - line) <= 5 for r in reads[max(0, bisect_right(reads, line) - 1) : bisect_right(reads, line) + 1])
        spared = [x for x in (marks.get(line), marks.get(line - 1)) if x]
        rows.append((kind, line, column, value, symbol, attribute, calls, new, places.lines[line - 1], near, spared))
    return rows


_PS_SIGN = re.compile(r"<#.*?(?:#>|\Z)|#[^\n]*|`\r?\n|@([\"'])[ \t]*\r?\n(.*?)(?:\r?\n\1@|\Z)|\"(?:`.|\"\"|[^\"`])*(?:\"|\Z)|'(?:''|[^'])*(?:'|\Z)|\r?\n|[|;{}()=]|[^\s|;{}()\"'`=]+|`.", re.S)


def powershell(text: str, marker: str) -> list[tuple]:
    """Rows of ``POWERSHELL``: arguments of commands, quoted or bare, with the parameter that they are bound to and the words of their command so far."""
    places, marks, found = _Places(text), {}, []
    stack: list[list] = []
    command: list = [None, None, []]  # its name, the parameter waiting for a value, its words
    for m in _PS_SIGN.finditer(text):
        t, start = m[0], m.start()
        if t.startswith(("#", "<#")):
            if told := re.search(rf"(?i){marker}:\s*ignore\s+([a-z0-9.-]+)", t):
                marks[places.of(start)[0]] = told[1].lower()
        elif t.startswith("`") and t.endswith("\n"):
            continue
        elif t in ("|", ";", "=") or t.endswith("\n") and not t.startswith("@"):
            if not (t != "=" and t.endswith("\n") and stack and stack[-1][0] == "(" and command[0] is None):
                command = [None, None, []]
        elif t in "({":
            stack.append([t, command])
            command = [None, None, []]
        elif t in ")}":
            while stack:
                bracket, outer = stack.pop()
                if bracket == {")": "(", "}": "{"}[t]:
                    command = outer
                    break
        else:
            quoted = t[0] in "\"'" or t.startswith(('@"', "@'"))
            if command[0] is None and not quoted:
                command[0] = t
                continue
            if not quoted and re.match(r"-[A-Za-z]", t):
                command[1], sep, given = t[1:].partition(":")
                if not (sep and given):
                    continue
                t, start = given, start + len(t) - len(given)
            value = m[2] if t.startswith("@") and m[2] is not None else t[1:].removesuffix(t[0]).replace(t[0] * 2, t[0]) if quoted else t
            if quoted and t[0] == '"':
                value = re.sub(r"`(.)", r"\1", value)
            command[2].append(value)
            if command[0]:
                found.append((start, value, command[0], command[1], command[2]))
            command[1] = None
    rows = []
    for start, value, name, parameter, words in found:
        line, column = places.of(start)
        rows.append((line, column, value, name, parameter, list(words[:64]), places.lines[line - 1], [x for x in (marks.get(line), marks.get(line - 1)) if x]))
    return rows


TEXT = "kind string, line int, column int, value string, content string"


def found_in(text: str, patterns: dict[str, str], after: dict[str, str]) -> list[tuple]:
    """Rows of ``TEXT``: all that each pattern finds in a text; of a kind in ``after`` only what stands behind a match of that pattern on its line. ASCII alone counts as letters."""
    places, rows = _Places(text), []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text, re.ASCII):
            line, column = places.of(m.start())
            if kind not in after or re.search(after[kind], text[places.starts[line - 1] : m.start()], re.ASCII | re.IGNORECASE):
                rows.append((kind, line, column, m[0], places.lines[line - 1]))
    return rows


LINES = "kind string, line int, column int, value string, content string, spared array<string>"


def in_lines(text: str, patterns: dict[str, str], marker: str) -> list[tuple]:
    """Rows of ``LINES``: all that each pattern finds within the lines of a text, with the rules that comments on the line and above suppress."""
    # a dot stops at the same signs as in expressions
    patterns = {k: re.compile(p.replace(r"\\.", r"\\[^\n\r\x85\u2028\u2029]")) for k, p in patterns.items()}
    rows, above, named = [], "", re.compile(rf"{marker}:\s*ignore\s+([a-z0-9.-]+)", re.ASCII | re.IGNORECASE)
    for line, content in enumerate(text.split("\n"), 1):
        content = content[:-2] if content.endswith("\r\r") else content.removesuffix("\r")
        told = named.search(content)
        own = told[1].lower() if told else ""
        rows += [(kind, line, m.start() + 1, m[0], content, [own, above]) for kind, p in patterns.items() for m in p.finditer(content)]
        above = own
    return rows


#: Tokens and texts, and characters of texts, that a task holds for equal texts to come.
POOL, CHARACTERS = 50_000, 1 << 24


def tokens(files: DataFrame, read, schema: str) -> DataFrame:
    """``files(path, category, language, text)`` -> a row for each tuple that ``read(text)`` gives, of ``schema``, with the file's other columns.

    A task reads equal texts once, until the texts or tokens that it holds are more than ``POOL`` or ``CHARACTERS``; then it starts anew.
    """

    def run(batches):
        known: dict[str, tuple[int, int]] = {}  # where the tokens of a text lie in ``pool``
        pool, size = told([]), 0
        for b in batches:
            texts, rows, found = [t or "" for t in b.column(3).to_pylist()], [], pool.num_rows
            if found > POOL or size > CHARACTERS or len(known) > POOL:
                known, pool, found, size = {}, told([]), 0, 0
            for t in texts:
                if t not in known:
                    new = read(t)
                    known[t] = (found, len(new))
                    size += len(t)
                    found += len(new)
                    rows += new
                    if len(rows) >= 5000:
                        pool, rows = joined(pool, rows), []
            pool = joined(pool, rows)
            first, count = np.array([known[t] for t in texts], dtype=np.int64).reshape(-1, 2).T
            ends = np.cumsum(count)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, 5000):
                place = np.arange(lo, min(lo + 5000, int(ends[-1])))
                file = np.searchsorted(ends, place, side="right")
                at = place - (ends - count)[file] + first[file]
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(pa.array(file)) for j in range(3)), *(c.take(pa.array(at)) for c in pool.columns)], names=["path", "category", "language", *kinds])

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds.values(), strict=True)], names=list(kinds))

    def joined(pool, rows):
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(pool.columns, told(rows).columns, strict=True)], names=list(kinds)) if rows else pool

    kinds = {f.split()[0]: {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[f.split()[1]] for f in re.split(r", (?![^<]*>)", schema)}
    return files.select("path", "category", "language", "text").mapInArrow(run, f"path string, category string, language string, {schema}")
