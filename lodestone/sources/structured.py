"""Scalars of JSON and YAML texts as rows, read by one parser run a batch of files.

A text that cannot be parsed gives one row with ``error`` and its place. YAML needs the ``yaml``
package; without it YAML texts are reported as errors.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALARS = "path string, at string, key string, value string, line int, column int, error string"
FLAT = "path string, key string, value string, error string"


def _pairs(text: str):
    """JSON with numbers as written and objects as lists of pairs, so that repeated keys stay."""
    return json.loads(text, parse_int=str, parse_float=str, parse_constant=str, object_pairs_hook=lambda p: ("object", p))


def _yaml_nodes(text: str):
    import yaml

    return list(yaml.compose_all(text, Loader=yaml.SafeLoader))


def _json_scalars(node, at: str, key):
    if isinstance(node, tuple):
        for k, v in node[1]:
            yield from _json_scalars(v, f"{at}.{k}", k)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from _json_scalars(v, f"{at}[{i}]", key)
    elif node is not None:
        yield at, key, str(node), 1, 1


def _yaml_scalars(node, at: str, key):
    if node.id == "scalar":
        yield at, key, node.value, node.start_mark.line + 1, node.start_mark.column + 1
    elif node.id == "sequence":
        for i, v in enumerate(node.value):
            yield from _yaml_scalars(v, f"{at}[{i}]", None)
    else:
        for k, v in node.value:
            name = str(k.value)
            yield from _yaml_scalars(v, f"{at}.{name}", name if v.id == "scalar" else None)


def scalars_of(path: str, text: str | None) -> list[tuple]:
    """``(at, key, value, line, column, error)`` of one file: items of a JSON list keep its key, those of a YAML list have none."""
    try:
        if path.lower().endswith(".json"):
            return [(*s, None) for s in _json_scalars(_pairs(text or ""), "$", None)]
        return [(*s, None) for n in _yaml_nodes(text or "") if n is not None for s in _yaml_scalars(n, "$", None)]
    except json.JSONDecodeError as e:
        return [("$", None, None, e.lineno, e.colno, e.msg)]
    except RecursionError:
        return [("$", None, None, 1, 1, "nested too deeply")]
    except Exception as e:  # the YAML package's own errors, whose class is not known without it
        mark = getattr(e, "problem_mark", None)
        if not isinstance(e, ImportError | ValueError) and mark is None and type(e).__module__.split(".")[0] != "yaml":
            raise
        return [("$", None, None, (mark.line if mark else 0) + 1, (mark.column if mark else 0) + 1, str(getattr(e, "problem", None) or e))]


def flat_of(path: str, text: str | None) -> list[tuple]:
    """``(key, value, error)`` of one file, keys as paths from the top; of keys that differ in case only the last value counts."""
    found = scalars_of(path, text)
    if found and found[0][-1] is not None:
        return [(None, None, found[0][-1])]
    out: dict[str, tuple] = {}
    nulls = [(a, "") for a in _nulls(_pairs(text or ""), "$")] if path.lower().endswith(".json") else []
    for at, value in [*((s[0], s[2]) for s in found), *nulls]:
        key = re.sub(r"^\$\.?", "", at)
        out[key.lower()] = (out.get(key.lower(), (key,))[0], value, None)
    return list(out.values())


def _nulls(node, at: str):
    if isinstance(node, tuple):
        for k, v in node[1]:
            yield from _nulls(v, f"{at}.{k}")
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from _nulls(v, f"{at}[{i}]")
    elif node is None:
        yield at


def _mapped(files: DataFrame, of, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [(p, *r) for p, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in of(p or "", t)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=names)

    return files.where(F.col("path").rlike(r"(?i)\.(json|ya?ml)$")).select("path", "text").mapInArrow(run, schema)


def scalars(files: DataFrame) -> DataFrame:
    """``files(path, text)`` -> ``(path, at, key, value, line, column, error)`` of the JSON and YAML files."""
    return _mapped(files, scalars_of, SCALARS)


def flatten(files: DataFrame) -> DataFrame:
    """``files(path, text)`` -> ``(path, key, value, error)`` of the JSON and YAML files."""
    return _mapped(files, flat_of, FLAT)
