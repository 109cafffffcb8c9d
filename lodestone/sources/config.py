"""Configuration of a repository: rules, allow list, suppressions, services, literals; read and checked in the driver.

These are small files that people write. YAML needs the ``yaml`` package; without it a file with
content is an error.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field

from ..functions.globs import strict
from ..operators import catalog

SEVERITIES = ("error", "warning", "info")
CATEGORIES = ("Source", "Config")
FOLDER = "rules"
TEMPLATES = {
    "rules/rules.yaml": "rules: {}\n",
    "rules/allowlist.yaml": "allowlist: []\n",
    "rules/custom/example.yaml": "customRules: []\n",
}


#: Files beside the rules, at the root of a repository.
SUPPRESSIONS, LITERALS, SERVICES = "lodestone.suppressions.yaml", "lodestone.literals.yaml", "service-map.txt"


@dataclass
class Bundle:
    """The rules in force and all else that is configured, with warnings and errors of reading it."""

    rules: dict = field(default_factory=dict)  # id in lower case -> (id, enabled, severity)
    custom: list = field(default_factory=list)
    allow: list = field(default_factory=list)
    settings: dict = field(default_factory=dict)
    warnings: list = field(default_factory=list)
    errors: list = field(default_factory=list)

    def digest(self) -> str:
        """A hash of what is in force."""
        told = repr((sorted(self.rules.items()), sorted(map(repr, self.custom)), sorted(map(repr, self.allow)), sorted(self.settings.items())))
        return hashlib.sha256(told.encode()).hexdigest()

    def policy_rows(self) -> list[tuple]:
        """``(rule_id, enabled, severity)`` for ``apply_policy``."""
        return [(r, e, s) for r, e, s in self.rules.values()]


def read_yaml(text: str):
    """The content of a YAML text, or ``ValueError``."""
    if not text.strip():
        return None
    try:
        import yaml
    except ImportError as e:
        raise ValueError("the yaml package is missing") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def find_root(path: str) -> str:
    """The nearest folder at or above ``path`` with a ``.git`` in it, else ``path``."""
    at = os.path.abspath(path)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        up = os.path.dirname(at)
        if up == at:
            return os.path.abspath(path)
        at = up


def head_sha(root: str) -> str | None:
    """The commit that HEAD names, directly or by a loose reference."""
    try:
        with open(os.path.join(root, ".git", "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
        if head.startswith("ref:"):
            with open(os.path.join(root, ".git", *head[4:].strip().split("/")), encoding="utf-8") as f:
                head = f.read().strip()
        return head or None
    except OSError:
        return None


def _texts(root: str, *folders: str) -> list[tuple[str, str]]:
    out = []
    for folder in folders:
        at = os.path.join(root, folder)
        for name in sorted(os.listdir(at)) if os.path.isdir(at) else ():
            if name.lower().endswith((".yaml", ".yml")):
                with open(os.path.join(at, name), encoding="utf-8") as f:
                    out.append((f"{folder}/{name}", f.read()))
    return out


def _custom(source: str, item, bundle: Bundle) -> dict | None:
    if not isinstance(item, dict):
        bundle.errors.append(f"{source}: a rule must be a mapping")
        return None
    missing = [k for k in ("id", "pattern", "message") if not str(item.get(k) or "").strip()]
    if missing:
        bundle.errors.append(f"{source}: rule without {', '.join(missing)}")
        return None
    try:
        re.compile(str(item["pattern"]))
    except re.error as e:
        bundle.errors.append(f"{source}: {item['id']}: {e}")
        return None
    severity = str(item.get("severity", "Warning")).capitalize()
    if severity.lower() not in SEVERITIES:
        bundle.errors.append(f"{source}: {item['id']}: no such severity: {severity}")
        return None
    categories = item.get("categories") or item.get("fileCategories") or CATEGORIES
    return {"id": str(item["id"]), "pattern": str(item["pattern"]), "message": str(item["message"]), "severity": severity, "categories": [str(c) for c in categories], "enabled": item.get("enabled", True) is not False, "source": source}


def load(root: str, overrides: dict | None = None) -> Bundle:
    """Built-in rules, then those of ``rules/*.yaml``, of ``rules/custom/*.yaml`` and ``overrides`` (id -> severity or False); each later source wins."""
    bundle = Bundle(rules={r.lower(): (r, True, s) for r, s in catalog.RULES.items()})
    set_by: dict[str, str] = {}
    for source, text in _texts(root, FOLDER, f"{FOLDER}/custom"):
        try:
            data = read_yaml(text)
        except ValueError as e:
            bundle.errors.append(f"{source}: {e}")
            continue
        if data is None:
            continue
        if not isinstance(data, dict):
            bundle.warnings.append(f"{source}: the file is not a mapping")
            continue
        known = {"rules", "customRules", "allowlist", "settings"}
        bundle.warnings += [f"{source}: unknown entry {k}" for k in data if k not in known]
        for rule, value in (data.get("rules") or {}).items():
            key = str(rule).lower()
            if key not in bundle.rules:
                bundle.errors.append(f"{source}: unknown rule {rule}")
                continue
            if key in set_by:
                bundle.warnings.append(f"{source}: {rule} was set by {set_by[key]}")
            set_by[key] = source
            given = value if isinstance(value, dict) else {"severity": value} if isinstance(value, str) else {"enabled": value}
            name, enabled, severity = bundle.rules[key]
            wanted = str(given.get("severity") or severity).capitalize()
            if wanted.lower() not in SEVERITIES:
                bundle.errors.append(f"{source}: {rule}: no such severity: {wanted}")
                wanted = severity
            bundle.rules[key] = (name, given.get("enabled", enabled) is not False, wanted)
        for item in data.get("customRules") or ():
            made = _custom(source, item, bundle)
            if made and any(c["id"].lower() == made["id"].lower() for c in bundle.custom):
                bundle.errors.append(f"{source}: {made['id']} is there twice")
            elif made:
                bundle.custom.append(made)
        for item in data.get("allowlist") or ():
            entry = {"path": str(item.get("path") or "**"), "rule": str(item.get("rule") or ""), "pattern": item.get("pattern")} if isinstance(item, dict) else None
            try:
                if entry is None:
                    raise ValueError("an entry must be a mapping")
                strict(entry["path"])
                re.compile(str(entry["pattern"] or ""))
            except (ValueError, re.error) as e:
                bundle.errors.append(f"{source}: allow list: {e}")
                continue
            bundle.allow.append(entry)
        bundle.settings |= {str(k): v for k, v in (data.get("settings") or {}).items()}
    for rule, value in (overrides or {}).items():
        key = rule.lower()
        if key in bundle.rules:
            name, _, severity = bundle.rules[key]
            bundle.rules[key] = (name, value is not False, value if isinstance(value, str) else severity)
        else:
            bundle.errors.append(f"unknown rule {rule}")
    return bundle


def validate(root: str) -> tuple[list, list]:
    """``(errors, warnings)`` of a repository's configuration."""
    bundle = load(root)
    return bundle.errors, bundle.warnings


def rule_list(bundle: Bundle) -> list[tuple]:
    """``(rule, severity, enabled, source)`` of all rules, built in and the user's."""
    return sorted([(r, s, e, "built-in") for r, e, s in bundle.rules.values()] + [(c["id"], c["severity"], c["enabled"], c["source"]) for c in bundle.custom])


def suppressions(text: str) -> list[dict]:
    """Entries of a suppression file: lines ``- path: glob``, ``rule: id``, ``fingerprint: hash``; an entry without path or rule does not count."""
    out: list[dict] = []
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("-"):
            out.append({})
            line = line.lstrip("-").strip()
        key, sep, value = line.partition(":")
        key = {"rule_id": "rule"}.get(key.strip().lower(), key.strip().lower())
        if out and sep and key in ("path", "rule", "fingerprint"):
            out[-1][key] = value.strip().strip("'\"")
    return [e for e in out if e.get("path") and e.get("rule")]


def services(text: str) -> list[tuple[str, str]]:
    """``(service, glob)`` of lines ``name=glob`` or ``name: glob``, in order."""
    out = []
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        m = re.match(r"([^=:]+)[=:](.+)", line)
        if m and m[1].strip() and m[2].strip():
            out.append((m[1].strip(), m[2].strip()))
    return out


def literal_settings(text: str) -> dict:
    """Settings of literals: limits, allow and deny lists, logging calls by language; unknown entries and values of another kind are left out."""
    data = read_yaml(text) or {}
    numbers = {k: v for k, v in data.items() if isinstance(v, int | float) and not isinstance(v, bool)}
    lists = {k: [str(x) for x in v] for k, v in data.items() if isinstance(v, list)}
    sinks = {str(k).lower(): [str(x) for x in v] for k, v in (data.get("loggingSinks") or {}).items() if isinstance(v, list)}
    return {"numbers": numbers, "allow": lists.get("allowlist", []), "deny": lists.get("denylist", []), "sinks": sinks}


def side_files(root: str, bundle: Bundle) -> dict:
    """``suppressions``, ``literals`` and ``services`` of a repository; what cannot be read is an error of ``bundle``."""
    out = {"suppressions": [], "literals": {}, "services": []}
    for key, name, read in (("suppressions", SUPPRESSIONS, suppressions), ("literals", LITERALS, literal_settings), ("services", SERVICES, services)):
        try:
            with open(os.path.join(root, name), encoding="utf-8") as f:
                out[key] = read(f.read())
        except FileNotFoundError:
            continue
        except (OSError, ValueError) as e:
            bundle.errors.append(f"{name}: {e}")
    return out


def look_back(bundle: Bundle, given: str | None = None, default: int = 365) -> int:
    """Days of history to look at: those given (``90d``), else ``churn.sinceDays``, else ``churn.since`` of the settings."""
    churn = bundle.settings.get("churn") if isinstance(bundle.settings.get("churn"), dict) else {}
    told = lambda name: churn.get(name, bundle.settings.get(f"churn.{name}"))
    number = told("sinceDays")
    fixed = number if isinstance(number, int) and not isinstance(number, bool) and number > 0 else days(str(told("since") or ""), default)
    return days(given, fixed)


def ignore_patterns(root: str) -> list[str]:
    """Lines of the ignore file at the root."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            return f.read().splitlines()
    except OSError:
        return []


def days(text: str | None, default: int) -> int:
    """``90d`` as 90; anything else is the default."""
    m = re.fullmatch(r"\s*([0-9]+)\s*d\s*", text or "", re.IGNORECASE)
    return int(m[1]) if m and int(m[1]) > 0 else default


def scaffold(root: str) -> list[str]:
    """Write the templates that are not there yet; returns the paths written."""
    made = []
    for name, text in TEMPLATES.items():
        path = os.path.join(root, *name.split("/"))
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            made.append(path)
    return made
