"""Manifest queries; each order is a project whose dependencies are the brands of its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests as op
from ..sources.bindings import table
from .registry import query


def _manifests(spark, folder):
    """Four manifests per order, their text built from the sorted brands of its (at most seven) lines."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    brands = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey").groupBy(
        "l_orderkey").agg(F.array_sort(F.collect_list("p_brand")).alias("b"))
    each = lambda form, glue: F.array_join(F.transform("b", form), glue)
    npm = F.concat(
        F.lit('{"name": "x", "dependencies": {'),
        F.array_join(F.transform(F.array_distinct("b"), lambda x: F.concat(F.lit('"'), x, F.lit('": "1.0"'))), ", "),
        F.lit('}, "devDependencies": {"'), F.col("b")[0], F.lit('": "2.0", "jest": "29"}}'),
    )
    pip = F.concat(F.lit("# pinned\n\n"), each(lambda x: F.concat(F.translate(x, "#", "-"), F.lit(" == 1.0  # "), x), "\n"), F.lit("\nflask>=2\n"))
    maven = F.concat(F.lit("<project><artifactId>self</artifactId>\n"), each(
        lambda x: F.concat(F.lit("<dependency><artifactId>"), x, F.lit("</artifactId></dependency>")), "\n"), F.lit("</project>"))
    nuget = F.concat(F.lit("<Project>"), each(
        lambda x: F.concat(F.lit('<PackageReference  Include="'), x, F.lit('" Version="1"/>')), "\n"), F.lit("</Project>"))
    rows = [("package.json", npm), ("requirements.txt", pip), ("pom.xml", maven), ("app.csproj", nuget)]
    files = F.array(*[F.struct(F.lit(n).alias("filename"), c.alias("content")) for n, c in rows])
    return brands.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("root"), F.inline(files))


B = """
WITH b AS (SELECT 'order/' || l_orderkey AS root, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey),
npm AS (SELECT root, string_agg(d, ',' ORDER BY d) AS deps FROM (
          SELECT DISTINCT root, brand AS d FROM b UNION ALL SELECT root, min(brand) FROM b GROUP BY root
          UNION ALL SELECT DISTINCT root, 'jest' FROM b) GROUP BY root),
pip AS (SELECT root, string_agg(d, ',' ORDER BY d) AS deps FROM (
          SELECT root, replace(brand, '#', '-') || ' ' AS d FROM b UNION ALL SELECT DISTINCT root, 'flask' FROM b) GROUP BY root),
maven AS (SELECT root, string_agg(d, ',' ORDER BY d) AS deps FROM (
          SELECT DISTINCT root, brand AS d FROM b UNION ALL SELECT DISTINCT root, 'self' FROM b) GROUP BY root),
nuget AS (SELECT root, string_agg(DISTINCT brand, ',' ORDER BY brand) AS deps FROM b GROUP BY root)
"""


def _one(kind: str):
    def build(spark, folder):
        rows = op.dependencies(_manifests(spark, folder)).where(F.col("kind") == kind)
        return rows.select("root", F.array_join("deps", ",").alias("deps"))

    build.__name__ = f"deps_{kind}"
    return build


for _kind in ("npm", "pip", "maven", "nuget"):
    query(f"deps_{_kind}", B + f"SELECT root, deps FROM {_kind}")(_one(_kind))


@query("deps_clusters", B + """
, s AS (SELECT 'npm:' || deps AS signature, root FROM npm UNION ALL SELECT 'pip:' || deps, root FROM pip
        UNION ALL SELECT 'maven:' || deps, root FROM maven UNION ALL SELECT 'nuget:' || deps, root FROM nuget)
SELECT signature, root, count(*) OVER (PARTITION BY signature) AS members FROM s QUALIFY members > 1""")
def deps_clusters(spark, folder):
    return op.deps_clusters(_manifests(spark, folder))
