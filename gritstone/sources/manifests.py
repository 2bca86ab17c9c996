"""What manifests, remotes and settings say, as column functions and small parsers."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remote_name(url: Column) -> Column:
    """``(host, name)`` of a remote in any of the forms git takes: every segment of the name, without ``.git``; null where there is
    none or a segment is ``.`` or ``..``."""
    clean = F.regexp_replace(F.trim(url), r"(\.git)?/*$", "")
    host = F.coalesce(F.nullif(F.regexp_extract(clean, r"^[a-z+]+://(?:[^/@]*@)?([^/:]+)", 1), F.lit("")), F.nullif(F.regexp_extract(clean, r"^(?:[^/@:]+@)?([^/:]+):(?!//)", 1), F.lit("")))
    name = F.coalesce(F.nullif(F.regexp_extract(clean, r"^[a-z+]+://[^/]+/+(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(clean, r"^(?:[^/@:]+@)?[^/:]+:(?!//)/*(.+)$", 1), F.lit("")))
    sound = ~F.exists(F.split(name, "/"), lambda x: x.isin("", ".", ".."))
    return F.when(host.isNotNull() & name.isNotNull() & sound, F.struct(F.lower(host).alias("host"), name.alias("name")))


def go_module(path: Column, text: Column) -> Column:
    """``(module, directory)`` of a ``go.mod``."""
    module = F.nullif(F.regexp_extract(text, r'(?m)^\s*module\s+"?([^\s"]+)', 1), F.lit(""))
    return F.when(module.isNotNull(), F.struct(module.alias("module"), F.regexp_replace(path, "(^|/)go\\.mod$", "").alias("directory")))


def cargo_crate(path: str, text: str | None) -> tuple[str, str] | None:
    """``(name, file)`` of the library a ``Cargo.toml`` declares: its own name or the package's, and where its source begins."""
    try:
        held = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return None
    library, package = held.get("lib") or {}, held.get("package") or {}
    name = library.get("name") or package.get("name")
    if not isinstance(name, str) or not name:
        return None
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    return name.replace("-", "_"), folder + str(library.get("path") or "src/lib.rs")


def ignored_globs(text: str | None, at: str) -> list[str]:
    """The globs of the files a project leaves out: a list of texts under ``ignore``; anything else is an error."""
    import yaml

    held = yaml.safe_load(text or "") or {}
    listed = held.get("ignore", []) if isinstance(held, dict) else None
    if not isinstance(listed, list) or not all(isinstance(g, str) and g.strip() for g in listed):
        raise ValueError(f"{at}: ignore is a list of globs")
    return [g.strip() for g in listed]


def scan_types(text: str | None, at: str) -> list[str] | None:
    """The types of issues a project asks about, in lower case; None where it does not say."""
    import yaml

    held = yaml.safe_load(text or "") or {}
    listed = held.get("scan_types") if isinstance(held, dict) else None
    if listed is None:
        return None
    if not isinstance(listed, list) or not all(isinstance(t, str) and t.strip() for t in listed):
        raise ValueError(f"{at}: scan_types is a list of types")
    return [t.strip().lower() for t in listed]


def settings(text: str | None, known: Sequence[str], environment: dict[str, str] | None = None) -> dict[str, str]:
    """Quoted settings of a file, one a line, and over them those of the environment; an unknown, repeated or empty one is an error."""
    out: dict[str, str] = {}
    for number, line in enumerate((text or "").split("\n"), 1):
        if not line.strip() or line.strip().startswith("#"):
            continue
        m = re.fullmatch(r"""\s*([A-Za-z_][\w-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')\s*(?:#.*)?""", line)
        if not m:
            raise ValueError(f"line {number}: a setting is written name = \"value\"")
        name, value = m[1], m[2] if m[2] is not None else m[3]
        if name not in known or name in out or not value:
            raise ValueError(f"line {number}: {name} is {'repeated' if name in out else 'empty' if name in known else 'unknown'}")
        out[name] = value
    return out | {k: v for k, v in (environment or {}).items() if k in known and v}


def switch_hits(rows: DataFrame, names: DataFrame, text: str = "line") -> DataFrame:
    """``(id, test)`` from lines ``id TAB thread``: a thread is named like its test behind a path of modules, and the test with the longest
    such name that is the only one decides. ``names(test, name)``."""
    parts = F.split(text, "\t")
    hits = rows.where(F.size(parts) == 2).select(parts[0].alias("id"), parts[1].alias("thread")).distinct()
    segments = F.split("thread", "::")
    tails = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "::"))
    asked = hits.select("thread").distinct().select("thread", F.posexplode(tails).alias("cut", "name"))
    met = asked.join(names, "name").groupBy("thread", "cut").agg(F.min("test").alias("test"), F.max("test").alias("last"))
    best = met.groupBy("thread").agg(F.min(F.struct("cut", "test", "last")).alias("b")).where("b.test = b.last").select("thread", F.col("b.test").alias("test"))
    return hits.join(best, "thread").select("id", "test").distinct()


def case_node(cases: DataFrame, tree: DataFrame) -> DataFrame:
    """``(classname, name, node)``: the node of a JUnit case: the longest prefix of its dotted class name that is a file of ``tree(path)``, then
    the classes and the name."""
    parts = F.split("classname", r"\.")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("cut"), F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit(".py")).alias("path")))
    asked = cases.select("classname", "name").distinct().select("classname", "name", F.explode(cuts).alias("c")).select("classname", "name", "c.cut", "c.path")
    best = asked.join(tree.select("path").distinct(), "path").groupBy("classname", "name").agg(F.max(F.struct("cut", "path")).alias("b"))
    classes = F.slice(parts, F.col("b.cut") + 1, F.size(parts))
    return best.select("classname", "name", F.array_join(F.concat(F.array("b.path"), classes, F.array("name")), "::").alias("node"))
