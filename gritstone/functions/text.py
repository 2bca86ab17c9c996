"""Column functions over texts and paths: sizes, lines, comments, generated files, languages, identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: UTF-8 bytes that count as one token. Fixed value.
BYTES_PER_TOKEN = 3

# Directory names that hold dependencies or output wherever they stand, and pairs of them. Fixed values.
EXCLUDED_DIRECTORIES = (
    ".git", "vendor", "node_modules", "dist", "target", "build", "coverage", "out", "third_party", "third-party", "thirdparty", "3rdparty", ".cache",
    ".next", ".nuxt", ".output", ".svelte-kit", ".angular", ".parcel-cache", ".turbo", ".vite", ".npm", ".pnpm-store", "bower_components", "jspm_packages",
    "web_modules", "storybook-static", ".docusaurus", ".nyc_output", ".venv", "venv", "site-packages", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", ".nox", ".eggs", "htmlcov", ".gradle", ".bloop", ".metals", ".scala-build", ".cxx", ".externalNativeBuild", "CMakeFiles", "_deps",
    "bazel-bin", "bazel-out", "bazel-testlogs", ".build", "Pods", "DerivedData", ".zig-cache", "zig-cache", "zig-out", ".dart_tool", ".pub-cache", ".pub",
    ".stack-work", "dist-newstyle", ".cabal-sandbox", "_build", ".elixir_ls", "lua_modules", "blib", ".precomp", ".cpcache", ".godot", ".import",
)
EXCLUDED_PAIRS = (
    ".yarn/cache", ".yarn/unplugged", ".vitepress/cache", ".vitepress/dist", "Carthage/Build", "Carthage/Checkouts", "renv/library", "renv/staging",
    "packrat/lib", "packrat/lib-ext", ".clj-kondo/.cache", "Godeps/_workspace",
)

# Marks of generators in a file's first 40 lines; fixed values, read by Java and RE2 alike.
GENERATED_MARKS = (
    r"(?i)^\s*(//|#|--|;|/\*+|\*)\s*Code generated\b.*\bDO NOT EDIT\b",
    r"(?i)^\s*(//|#|--|/\*+|\*)\s*@generated\b",
    r"Generated by the protocol buffer compiler\.\s+DO NOT EDIT!",
    r"GENERATED CODE -- DO NOT EDIT!",
    r"^\s*// Generated by the gRPC",
    r"Autogenerated by Thrift Compiler",
    r"DO NOT EDIT THIS FILE - it is machine generated",
    r"Generated by Cython",
)

# Languages by file extension, and by whole name before that; fixed values.
EXTENSIONS = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "es6": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "py": "python", "pyi": "python", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala", "groovy": "groovy", "gradle": "groovy",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "c_sharp", "rb": "ruby", "rake": "ruby", "php": "php", "phtml": "php",
    "lua": "lua", "swift": "swift", "zig": "zig", "sol": "solidity", "sh": "bash", "bash": "bash", "bats": "bash",
}
FILE_EXTENSIONS = {
    "md": "markdown", "mdx": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "tf": "hcl", "tfvars": "hcl", "hcl": "hcl", "html": "html", "htm": "html",
    "css": "css", "scss": "scss", "xml": "xml", "svg": "xml", "ini": "ini", "cfg": "ini", "sql": "sql", "ps1": "powershell", "psm1": "powershell", "psd1": "powershell", "vue": "vue",
    "svelte": "svelte", "ex": "elixir", "exs": "elixir", "dart": "dart",
}
FILE_NAMES = {"Dockerfile": "dockerfile", "Makefile": "make", "CMakeLists.txt": "cmake", "Gemfile": "ruby", "Rakefile": "ruby"}


def token_estimate(text: Column) -> Column:
    """Tokens by size: UTF-8 bytes over three, rounded up."""
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN).cast("long")


def lines_of(text: Column) -> Column:
    """The lines of a text, whatever its line ends."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def code_lines(text: Column) -> Column:
    """How many lines are neither blank, nor a comment, nor an import."""
    return F.size(F.filter(lines_of(text), lambda x: ~x.rlike(r"^\s*$") & ~x.rlike(r"^\s*(//|#|--|/\*|\*)") & ~x.rlike(r"^\s*(import|from|include|use|require|using|package)\b"))).cast("long")


def generated_reason(path: Column, text: Column) -> Column:
    """``minified``, ``source map``, ``generated`` or null: long average lines or a map's name at the end of scripts and style
    sheets, or a generator's mark in the first 40 lines."""
    lines = F.split(text, "\n")
    script = path.rlike(r"(?i)\.([cm]?js|css)$")
    average = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)) / F.size(lines)
    last = F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), 2)
    mark = F.exists(F.slice(lines, 1, 40), lambda x: x.rlike("|".join(f"({m})" for m in GENERATED_MARKS)))
    mapped = F.exists(last, lambda x: x.rlike(r"^/[*/][#@] source(Mapping)?URL|sourceURL="))
    return F.when(script & (average > 110), "minified").when(script & mapped, "source map").when(mark, "generated")


def eligible_path(path: Column) -> Column:
    """Whether no directory of a path holds dependencies or output and the file is not minified by name."""
    parts = F.split(path, "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 2), "/"))
    inside = F.arrays_overlap(above, F.array(*(F.lit(d) for d in EXCLUDED_DIRECTORIES)))
    paired = F.arrays_overlap(F.when(F.size(parts) > 2, F.slice(pairs, 1, F.size(parts) - 2)).otherwise(F.array(F.lit("")) ), F.array(*(F.lit(p) for p in EXCLUDED_PAIRS)))
    return ~path.rlike(r"\.min\.([cm]?[jt]s|[jt]sx)$") & ~inside & ~paired & ~F.exists(above, lambda x: x.rlike("^cmake-build-.+"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), key)


def language_of_path(path: Column, header: Column | str = "c") -> Column:
    """The language of a source file by its extension; a ``.h`` is what ``header`` says of its repository."""
    extension = F.element_at(F.split(path, r"\."), -1)
    return F.when(extension == "h", header if isinstance(header, Column) else F.lit(header)).otherwise(_lookup(EXTENSIONS, extension))


def file_language(path: Column) -> Column:
    """The language of a document or configuration file, by its name before its extension."""
    return F.coalesce(_lookup(FILE_NAMES, F.element_at(F.split(path, "/"), -1)), _lookup(FILE_EXTENSIONS, F.element_at(F.split(path, r"\."), -1)))


def identity(*parts: Column, digits: int = 16) -> Column:
    """A key of hex digits from the SHA-256 of the parts as a JSON array."""
    return F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, digits)


def finding_id(method: Column) -> Column:
    """The eight-digit key of a method's finding."""
    return identity(F.lit("finding"), method, digits=8)


def set_fingerprint(name: Column, digest: Column) -> Column:
    """An aggregate: a key for a set of named digests, whatever their order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", name, digest))), "\n"), 256), 1, 16)


def keep_end(text: Column, width: int) -> Column:
    """A text cut on the left to ``width`` characters, an ellipsis in place of what went."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.lit("…"), F.substring(text, -(width - 1), width - 1)))


def keep_start(text: Column, width: int) -> Column:
    """A text cut on the right to ``width`` characters, an ellipsis in place of what went."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def halstead(n1: Column, n2: Column, total1: Column, total2: Column) -> dict[str, Column]:
    """Halstead's measures from distinct and total operators and operands; zero where they have no value."""
    vocabulary, length = n1 + n2, total1 + total2
    volume = F.when(vocabulary > 0, length * F.log2(F.greatest(vocabulary, F.lit(1)))).otherwise(0.0)
    difficulty = F.coalesce(F.try_divide(n1.cast("double"), F.lit(2)) * F.try_divide(total2.cast("double"), n2), F.lit(0.0))
    effort = difficulty * volume
    return {"vocabulary": vocabulary, "length": length, "volume": volume, "difficulty": difficulty, "effort": effort, "time": effort / 18, "bugs": volume / 3000}


def maintainability(volume: Column, sloc: Column, cyclomatic: Column) -> Column:
    """The maintainability index from 0 to 100; 100 for an empty unit, null without a complexity."""
    raw = (171 - 5.2 * F.ln(F.greatest(volume, F.lit(1.0))) - 0.23 * cyclomatic - 16.2 * F.ln(F.greatest(sloc, F.lit(1)))) * 100 / 171
    return F.when(cyclomatic.isNull(), F.lit(None)).when(sloc == 0, F.lit(100.0)).otherwise(bounded(raw))


def control_score(cyclomatic: Column, nesting: Column) -> Column:
    """From 100 downwards with decisions and nesting."""
    return 100 * (1 - 0.7 * F.least(F.lit(1.0), (cyclomatic - 1) / 10) - 0.3 * F.least(F.lit(1.0), nesting / 5))


def risk_score(index: Column, control: Column) -> Column:
    """How risky a unit is to change, from 0 to 100, rounded to six places."""
    return F.round(bounded(0.65 * (100 - index) + 0.35 * (100 - control)), 6)


def bounded(value: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), value))


def any_of(values: Sequence[str], column: Column) -> Column:
    return F.array_contains(F.array(*(F.lit(v) for v in values)), column)
