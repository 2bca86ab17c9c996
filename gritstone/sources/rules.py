"""Rule files: YAML lists of questions, checked key by key, merged by name, and edited as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gritstone.functions.text import EXTENSIONS, FILE_EXTENSIONS, FILE_NAMES

# What a rule may say; fixed values.
KEYS = ("name", "type", "each", "where", "except", "language", "sees", "context", "ask", "true", "false", "options", "levels", "when", "min", "gate", "issue", "kind", "text", "ensure", "ensure_present", "ensure_absent", "disabled")
TYPES = ("noul", "choice", "score")
EACH = ("file", "method", "test")
SEES = ("self", "file", "calls", "callers", "neighbors")
QUANTIFIERS = ("ensure", "ensure_present", "ensure_absent")
LANGUAGES = sorted({*EXTENSIONS.values(), *FILE_EXTENSIONS.values(), *FILE_NAMES.values()})

SCHEMA = "name string, type string, each string, quantifier string, ask string, where_ array<string>, except_ array<string>, language array<string>, sees string, floor double, gate boolean, disabled boolean, file string, load_order int"


def _listed(value) -> list[str] | None:
    return None if value is None else [value] if isinstance(value, str) else [str(v) for v in value]


def parse_rules(text: str, at: str) -> list[dict]:
    """The rules of one file: a list, or a map with ``rules``. Anything else, an unknown key, type, language or unit, a floor outside
    0 to 100 or a floor by model without a default is an error that names the file and the rule."""
    import yaml

    held = yaml.safe_load(text)
    if isinstance(held, dict):
        held = held.get("rules")
    if held is None:
        return []
    if not isinstance(held, list) or not all(isinstance(r, dict) for r in held):
        raise ValueError(f"{at}: a list of rules is expected")
    return [check_rule(r, at) for r in held]


def check_rule(rule: dict, at: str) -> dict:
    name = rule.get("name")
    where = f"{at}: rule {name!r}"
    if not isinstance(name, str) or not name.strip():
        raise ValueError(f"{at}: a rule needs a name")
    if unknown := sorted(set(rule) - set(KEYS)):
        raise ValueError(f"{where}: unknown key {unknown[0]!r}")
    said = [q for q in QUANTIFIERS if q in rule]
    if len(said) > 1:
        raise ValueError(f"{where}: only one of {', '.join(QUANTIFIERS)}")
    for key, allowed in (("type", TYPES), ("each", EACH), ("sees", SEES)):
        if key in rule and rule[key] not in allowed:
            raise ValueError(f"{where}: {key} is one of {', '.join(allowed)}")
    for language in _listed(rule.get("language")) or []:
        if language not in LANGUAGES:
            raise ValueError(f"{where}: unknown language {language!r}")
    floor = rule.get("min")
    floors = floor if isinstance(floor, dict) else {"default": floor} if floor is not None else {}
    if floors and "default" not in floors:
        raise ValueError(f"{where}: min by model needs a default")
    for value in floors.values():
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 100:
            raise ValueError(f"{where}: min is from 0 to 100")
    if not said and not rule.get("disabled") and not rule.get("ask"):
        raise ValueError(f"{where}: a rule asks or ensures something")
    return {
        "name": name, "type": rule.get("type", "noul"), "each": rule.get("each", "method"), "quantifier": said[0] if said else None,
        "ask": " ".join(str(rule[said[0]] if said else rule.get("ask", "")).split()), "where_": _listed(rule.get("where")), "except_": _listed(rule.get("except")),
        "language": _listed(rule.get("language")), "sees": rule.get("sees", "self"), "floor": float(floors.get("default", 0)) / 100, "gate": bool(rule.get("gate", False)), "disabled": bool(rule.get("disabled", False)),
    }


def read_rules(spark: SparkSession, files: Sequence[tuple[str, str]]) -> DataFrame:
    """The rules of files ``(name, text)`` in reading order; of one name the last read stands, a disabled one removes it. Rule files are
    written by hand and few, so the driver reads them."""
    merged: dict[str, dict] = {}
    order = 0
    for name, text in files:
        for rule in parse_rules(text, name):
            merged[rule["name"]] = rule | {"file": name, "load_order": order}
            order += 1
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in merged.values() if not r["disabled"]], SCHEMA)


def parse_filters(text: str, vocabulary: dict[str, Sequence[str]]) -> list[tuple[str, str]]:
    """``key=value,value2,key2=value`` as clauses. Letter case, hyphens and underscores do not count and a bug is a defect; what the
    vocabulary does not have is an error that names what it has."""
    canon = lambda v: " ".join(v.strip().lower().replace("_", " ").replace("-", " ").split())
    out, key = [], None
    for clause in filter(None, (c.strip() for c in text.split(","))):
        name, eq, value = clause.partition("=")
        if eq:
            key = canon(name)
            if key not in vocabulary:
                raise ValueError(f"unknown filter {name.strip()!r}; filter on {', '.join(vocabulary)}")
        else:
            value = name
        if key is None:
            raise ValueError(f"{clause!r} is written key=value")
        wanted = "defect" if key == "type" and canon(value) == "bug" else canon(value)
        held = {canon(v): v for v in vocabulary[key]}
        if wanted not in held:
            raise ValueError(f"{key} {value.strip()!r} is not one of {', '.join(vocabulary[key])}")
        out.append((key, held[wanted]))
    return out
