"""Packages out of manifests: one row per declared dependency."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.arrays import let, running_sql
from vigilake.functions.hits import hit
from vigilake.functions.scalars import clean_npm_version, lookup, strip_range_signs
from vigilake.functions.text import split_lines
from vigilake.functions.versions import version_key, version_lt
from vigilake.rules.config import KNOWN_VULNERABLE

# Manifest names by ecosystem.
MANIFEST_ECOSYSTEMS = {
    "requirements.txt": "pypi", "pyproject.toml": "pypi", "setup.py": "pypi", "pipfile": "pypi", "poetry.lock": "pypi",
    "package.json": "npm", "package-lock.json": "npm", "yarn.lock": "npm",
    "go.mod": "go", "go.sum": "go",
    "cargo.toml": "rust", "cargo.lock": "rust",
    "pom.xml": "maven", "build.gradle": "maven",
}
# Shapes of dependency entries.
REQUIREMENT = r"^([a-zA-Z0-9_.-]+)\s*([><=!~]+)\s*([0-9][0-9a-zA-Z._-]*)"
QUOTED_REQUIREMENT = r"""["']([a-zA-Z0-9_.-]+)\s*([><=!~]+)\s*([0-9][0-9a-zA-Z._-]*)["']"""
INSTALL_REQUIRES = r"(?s)install_requires\s*=\s*\[(.*?)\]"
GO_REQUIRE = r"^([a-zA-Z0-9./\-_]+)\s+v([0-9][0-9a-zA-Z._+-]*)"
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")

PACKAGE_COLUMNS = ("name", "version", "version_key", "ecosystem", "file_path", "line_number")


def detect_ecosystem(name: Column) -> Column:
    """Ecosystem of a manifest file name, null for other files."""
    return lookup(F.lower(name), MANIFEST_ECOSYSTEMS)


def _packages(rows: DataFrame, ecosystem: str, lower: bool = True) -> DataFrame:
    name = F.lower("name") if lower else F.col("name")
    return rows.select(
        name.alias("name"), "version", version_key(F.col("version")).alias("version_key"),
        F.lit(ecosystem).alias("ecosystem"), F.col("file_path"),
        F.coalesce(F.col("line_number"), F.lit(None).cast("int")).cast("int").alias("line_number"),
    )


def _trimmed_lines(files: DataFrame, path: str, text: str) -> DataFrame:
    return files.select(F.col(path).alias("file_path"), F.posexplode(split_lines(F.col(text))).alias("_i", "_raw")).select(
        "file_path", (F.col("_i") + 1).alias("line_number"), F.regexp_replace("_raw", r"^\s+|\s+$", "").alias("line")
    )


def packages_requirements(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``name op version`` per line; blank and comment lines are passed over."""
    lines = _trimmed_lines(files, path, text).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = lines.where(F.rlike("line", F.lit(REQUIREMENT))).select(
        F.regexp_extract("line", REQUIREMENT, 1).alias("name"), F.regexp_extract("line", REQUIREMENT, 3).alias("version"),
        "file_path", "line_number",
    )
    return _packages(rows, "pypi")


def packages_pinned(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``name==version`` pins only, without markers."""
    lines = _trimmed_lines(files, path, text).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", "==", -1)
    version = F.split_part(F.split_part(F.trim(F.get(parts, F.lit(1))), F.lit(";"), F.lit(1)), F.lit(" "), F.lit(1))
    rows = lines.where(F.col("line").contains("==")).select(
        F.trim(F.get(parts, F.lit(0))).alias("name"), version.alias("version"), "file_path", "line_number"
    )
    return _packages(rows, "pypi")


def known_vulnerable_hits(name: Column, text: Column) -> Column:
    """Entries of package.json and pins of requirements.txt below a lowest safe version of the built-in list, as matches.

    The list is a constant of a few entries, so it is looked up in the row: no join and no shuffle.
    """
    bounds = F.from_json(F.lit(json.dumps(KNOWN_VULNERABLE)), "map<string,map<string,array<string>>>")

    def checked(rule: str, ecosystem: str, package: Column, version: Column, line: Column | None) -> Column:
        known = F.try_element_at(F.element_at(bounds, F.lit(ecosystem)), package)
        below = F.filter(known, lambda b: version_lt(strip_range_signs(version), b))
        return F.transform(F.slice(below, 1, 1), lambda b: hit(
            rule, line_start=line, matched_text=F.format_string("%s %s < %s", package, version, b)
        ))

    def npm_entry(e: Column) -> Column:
        return let(clean_npm_version(e["value"]), lambda v: F.when(v != "", checked("NPM001", "npm", e["key"], v, None)))

    def pin(raw: Column, i: Column) -> Column:
        def of_line(line: Column) -> Column:
            parts = F.split(line, "==", -1)
            version = F.split_part(F.split_part(F.trim(F.get(parts, F.lit(1))), F.lit(";"), F.lit(1)), F.lit(" "), F.lit(1))
            pair = F.struct(F.lower(F.trim(F.get(parts, F.lit(0)))).alias("name"), version.alias("version"))
            return F.when(~line.startswith("#"), let(pair, lambda p: checked("PIP002", "pypi", p["name"], p["version"], i + 1)))

        return F.when(raw.contains("=="), let(F.regexp_replace(raw, r"^\s+|\s+$", ""), of_line))

    parsed = F.from_json(text, ", ".join(f"{s} map<string,string>" for s in NPM_SECTIONS))
    entries = let(parsed, lambda p: F.flatten(F.array_compact(F.array(*[F.map_entries(p[s]) for s in NPM_SECTIONS]))))
    return F.flatten(F.array_compact(
        F.when(F.lower(name) == "package.json", F.transform(entries, npm_entry))
        .when(F.lower(name) == "requirements.txt", F.transform(split_lines(text), pin))
    ))


def packages_setup_py(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Entries of ``install_requires=[...]``."""
    block = F.regexp_extract(F.col(text), INSTALL_REQUIRES, 1)
    rows = files.select(
        F.col(path).alias("file_path"),
        F.explode(F.regexp_extract_all(block, F.lit(QUOTED_REQUIREMENT), F.lit(0))).alias("entry"),
    ).select(
        F.regexp_extract("entry", QUOTED_REQUIREMENT, 1).alias("name"),
        F.regexp_extract("entry", QUOTED_REQUIREMENT, 3).alias("version"),
        "file_path", F.lit(None).cast("int").alias("line_number"),
    )
    return _packages(rows, "pypi")


def packages_package_json(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Entries of the dependency maps, with cleaned versions."""
    schema = ", ".join(f"{s} map<string,string>" for s in NPM_SECTIONS)
    parsed = files.select(F.col(path).alias("file_path"), F.from_json(F.col(text), schema).alias("_j"))
    entries = F.flatten(F.array_compact(F.array(*[F.map_entries(F.col(f"_j.{s}")) for s in NPM_SECTIONS])))
    rows = parsed.select("file_path", F.explode(entries).alias("_e")).select(
        F.col("_e.key").alias("name"), clean_npm_version(F.col("_e.value")).alias("version"),
        "file_path", F.lit(None).cast("int").alias("line_number"),
    ).where(F.col("version") != "")
    return _packages(rows, "npm", lower=False)


def packages_go_mod(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``module vX.Y.Z`` lines."""
    lines = _trimmed_lines(files, path, text).where(F.rlike("line", F.lit(GO_REQUIRE)))
    rows = lines.select(
        F.regexp_extract("line", GO_REQUIRE, 1).alias("name"), F.regexp_extract("line", GO_REQUIRE, 2).alias("version"),
        "file_path", "line_number",
    )
    return _packages(rows, "go", lower=False)


# What a TOML line can be, as far as declared dependencies go.
TOML_HEADER = r"^\s*\[{1,2}\s*([^\[\]]+?)\s*\]{1,2}\s*(?:#.*)?$"
TOML_ENTRY = r"""^\s*("[^"]*"|'[^']*'|[A-Za-z0-9_-]+)\s*(?:\.\s*(version))?\s*=\s*(.*)$"""
TOML_STRING = r"""^("[^"]*"|'[^']*')"""
TOML_VERSION = r"""[{,\s]version\s*=\s*("[^"]*"|'[^']*')"""
TOML_STRINGS = r"""("[^"]*"|'[^']*')"""
#: Strings, and the comment that ends a line.
TOML_PARTS = r"""("[^"]*"|'[^']*'|#.*)"""


def _unquoted(value: Column) -> Column:
    return F.substring(value, F.lit(2), F.length(value) - 2)


def _toml_lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """Lines of TOML files with the table they stand in: file_path, line_number, section (blanks and quotes off), line.

    The header of each line is the last one at or before it, a running maximum inside the file's own array of lines.
    """
    lines = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n", -1)
    header = "'" + TOML_HEADER.replace("\\", "\\\\").replace("'", "\\'") + "'"
    heads = F.expr(running_sql(f"transform(_l, (x, i) -> if(x rlike {header}, i + 1, 0))", "max"))
    rows = files.select(F.col(path).alias("file_path"), lines.alias("_l")).where("_l is not null").withColumn("_h", heads)
    placed = rows.select("file_path", "_l", F.posexplode("_h").alias("_i", "_head"))
    section = F.regexp_replace(F.regexp_extract(F.get("_l", F.col("_head") - 1), TOML_HEADER, 1), r"""["'\s]""", "")
    return placed.select("file_path", (F.col("_i") + 1).alias("line_number"), F.when(F.col("_head") > 0, section).alias("section"), F.get("_l", F.col("_i")).alias("line"))


def _toml_table(files: DataFrame, path: str, text: str, table: str) -> DataFrame:
    """Versions declared in a table: ``name = "1"``, ``name = {version = "1"}``, ``name.version = "1"`` and ``[table.name]``."""
    lines = _toml_lines(files, path, text).where((F.col("section") == table) | F.col("section").startswith(table + "."))
    entry = lambda n: F.regexp_extract("line", TOML_ENTRY, n)
    own, key, value = F.col("section") == table, entry(1), entry(3)
    bare = F.when(F.rlike(key, F.lit(r"""^["']""")), _unquoted(key)).otherwise(key)
    direct = F.regexp_extract(value, TOML_STRING, 1)
    inside = F.when(F.startswith(value, F.lit("{")), F.regexp_extract(value, TOML_VERSION, 1)).otherwise("")
    found = F.when(own & (entry(2) == ""), F.when(direct != "", direct).otherwise(inside)).when(own | (key == "version"), direct).otherwise("")
    name = F.when(own, bare).otherwise(F.substring("section", F.lit(len(table) + 2), F.length("section")))
    rows = lines.where(F.rlike("line", F.lit(TOML_ENTRY))).select("file_path", name.alias("name"), found.alias("_v")).where("_v <> ''")
    return rows.select("name", _unquoted(F.col("_v")).alias("version"), "file_path", F.lit(None).cast("int").alias("line_number")).where("version <> ''")


def packages_pyproject(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Entries of ``[project].dependencies``, on one line or on many, read line by line inside Spark."""
    lines = _toml_lines(files, path, text).where("section = 'project'")
    begins = F.rlike("line", F.lit(r"^\s*dependencies\s*=\s*\["))
    plain = F.regexp_replace(F.regexp_replace("line", TOML_STRINGS, ""), "#.*$", "")
    marked = lines.select(
        "file_path", F.struct("line_number", F.when(begins, 1).otherwise(0).alias("begins"), F.contains(plain, F.lit("]")).cast("int").alias("ends"), "line").alias("_x")
    ).groupBy("file_path").agg(F.sort_array(F.collect_list("_x")).alias("_x"))  # the lines of one table of one file
    opened = F.expr(running_sql("transform(_x, (x, i) -> x.begins * (i + 1))", "max"))
    closed = F.expr(running_sql("transform(_x, (x, i) -> x.ends * (i + 1))", "max"))
    states = marked.withColumns({"_o": opened, "_c": closed})
    inside = F.expr("filter(_x, (x, i) -> _o[i] > 0 and (i = 0 or coalesce(get(_c, i - 1), 0) < _o[i]))")
    listed = states.select("file_path", F.explode(inside).alias("_x"))
    parts = F.filter(F.regexp_extract_all("_x.line", F.lit(TOML_PARTS), F.lit(1)), lambda t: ~F.startswith(t, F.lit("#")))
    specs = listed.select("file_path", F.explode(parts).alias("_s")).select("file_path", _unquoted(F.col("_s")).alias("spec"))
    rows = specs.where(F.rlike("spec", F.lit(REQUIREMENT))).select(
        F.regexp_extract("spec", REQUIREMENT, 1).alias("name"), F.regexp_extract("spec", REQUIREMENT, 3).alias("version"), "file_path", F.lit(None).cast("int").alias("line_number"),
    )
    return _packages(rows, "pypi")


def packages_pipfile(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Entries of ``[packages]``."""
    rows = _toml_table(files, path, text, "packages")
    bare = F.regexp_replace("version", r"""^["'*>=~!]+|["'*>=~!]+$""", "")
    return _packages(rows.withColumn("version", bare).where("version <> ''"), "pypi")


def packages_cargo(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Entries of ``[dependencies]``."""
    return _packages(_toml_table(files, path, text, "dependencies"), "rust", lower=False)


# Readers by manifest name.
READERS = {
    "requirements.txt": packages_requirements, "pyproject.toml": packages_pyproject, "setup.py": packages_setup_py,
    "pipfile": packages_pipfile, "package.json": packages_package_json, "go.mod": packages_go_mod,
    "cargo.toml": packages_cargo,
}


def extract_packages(files: DataFrame, path: str = "path", name: str = "name", text: str = "text") -> DataFrame:
    """Packages of all manifests known by name, with their repository where files have one."""
    has_repo = "repo" in files.columns
    placed = files.withColumn("_place", F.struct(*(["repo"] if has_repo else []), F.col(path).alias("path")))
    parts = [reader(placed.where(F.lower(name) == manifest), "_place", text) for manifest, reader in READERS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    own = {"repo": F.col("file_path.repo")} if has_repo else {}
    return out.withColumns({**own, "file_path": F.col("file_path.path")})


def distinct_packages(packages: DataFrame) -> DataFrame:
    return packages.select("name", "version", "ecosystem").distinct()


# Instructions read from Dockerfiles.
DOCKER_INSTRUCTIONS = ("FROM", "USER", "EXPOSE", "COPY", "ADD")


def dockerfile_instructions(files: DataFrame, keys=("path",), text: str = "text") -> DataFrame:
    """Instructions with their argument; the alias of a base image is cut off."""
    pattern = r"^(" + "|".join(DOCKER_INSTRUCTIONS) + r")\s+(.*)$"
    lines = files.select(*keys, F.posexplode(split_lines(F.col(text))).alias("_i", "_raw")).select(
        *keys, (F.col("_i") + 1).alias("line_no"), F.regexp_replace("_raw", r"^\s+|\s+$", "").alias("line")
    ).where(F.rlike("line", F.lit(pattern)))
    argument = F.trim(F.regexp_extract("line", pattern, 2))
    instruction = F.regexp_extract("line", pattern, 1)
    return lines.select(
        *keys, "line_no", instruction.alias("instruction"),
        F.when(instruction == "FROM", F.trim(F.regexp_replace(argument, r"\s+(?i:AS)\s+.*$", ""))).otherwise(argument).alias("argument"),
    )
