"""Dependency lists of package manifests and groups of projects that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import members_of_repeated_groups
from ..functions.text import line_array, once, strip
from ..session import cut_lineage


def _object_keys(document: Column, field: str) -> tuple[Column, Column]:
    """Keys of one object field, and whether the field is there without being an object.

    A document that is no object itself counts as such a fault.
    """
    keys = F.json_object_keys(F.get_json_object(document, f"$.{field}"))
    present = F.coalesce(F.array_contains(F.json_object_keys(document), field), F.lit(True))
    return F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))), present & keys.isNull()


def npm(content: Column) -> Column:
    """Sorted keys of both dependency objects; a name in both stays twice, broken JSON has none."""
    runtime, bad_runtime = _object_keys(content, "dependencies")
    develop, bad_develop = _object_keys(content, "devDependencies")
    return F.when(~bad_runtime & ~bad_develop, F.array_sort(F.concat(runtime, develop)))


def pip(content: Column) -> Column:
    """Text before the first of ``= > < ~`` on each line without its comment; not trimmed again."""
    lines = F.transform(line_array(content), lambda x: strip(F.split(x, "#", 2)[0]))
    return F.array_sort(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.split(x, "[=><~]", 2)[0]))


def _distinct_matches(content: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(1))))


def maven(content: Column) -> Column:
    return _distinct_matches(content, r"(?d)<artifactId>(.*?)</artifactId>")


def nuget(content: Column) -> Column:
    return _distinct_matches(content, r'(?Ud)PackageReference\s+Include="(.*?)"')


def dependencies(manifests: DataFrame) -> DataFrame:
    """(root, filename, kind, deps) of the files that are manifests and have dependencies."""
    name, content = F.col("filename"), F.col("content")
    kind = (
        F.when(name == "package.json", "npm").when(name == "requirements.txt", "pip")
        .when(name == "pom.xml", "maven").when(name.endswith(".csproj"), "nuget")
    )
    deps = (
        F.when(F.col("kind") == "npm", npm(content)).when(F.col("kind") == "pip", pip(content))
        .when(F.col("kind") == "maven", maven(content)).when(F.col("kind") == "nuget", nuget(content))
    )
    rows = once(manifests.withColumn("kind", kind).where(F.col("kind").isNotNull()), "deps", deps)
    return rows.where(F.size("deps") > 0).select("root", "filename", "kind", "deps")


def deps_clusters(manifests: DataFrame) -> DataFrame:
    """Projects with the dependency list of another: (signature, root, members), one row per project."""
    # Kept once: sizes and members both read it, and the manifests need not be parsed again.
    signed = cut_lineage(dependencies(manifests).select(
        F.concat("kind", F.lit(":"), F.array_join("deps", ",")).alias("signature"), "root"
    ))
    return members_of_repeated_groups(signed, "signature", "members")
