"""Queries over texts in Markdown and workflow files. Messages are conversations, workflows are made of orders and their line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown, workflows
from ..sources.io import read_table
from .base import query


@query("""
SELECT conv_id, turn, trim(regexp_replace(role || ' ' || coalesce(text, '') || ' w' || turn || ' and *code* w' || turn || ' alt quoted & A <b>raw</b> http://x/y_z *kept* last w' || turn, '\\s+', ' ', 'g')) AS plain
FROM conversations WHERE role IS NOT NULL
""")
def search_texts(spark, d):
    """Messages in Markdown as plain text for search: headings, emphasis, code, lists, links, images, quotes, entities, tags, autolinks, fences and references."""
    c = read_table(spark, d, "conversations").where("role IS NOT NULL")
    word = F.concat(F.lit("w"), F.col("turn").cast("string"))
    parts = [
        "# ", F.col("role"), "\n\n", F.coalesce("text", F.lit("")), "\n\n* **", word, "** and `*code*`\n* [*", word, '*](http://x/y "title") ![alt](i.png)\n\n',
        "> quoted &amp; &#65; <b>raw</b>\n> <http://x/y_z>\n\n```py\n*kept*\n```\n\nlast\n----\n[", word, "][ref]\n\n[ref]: http://x"]
    md = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return c.select("conv_id", "turn", markdown.search_text(md).alias("plain"))


@query("""
WITH s AS (
  SELECT l_orderkey AS k, l_returnflag AS flag, l_linenumber AS n, 'make ' || l_partkey AS made, 'test ' || l_suppkey AS tested FROM lineitem WHERE l_linenumber % 3 <> 1 AND l_orderkey % 10 <> 3),
r AS (
  SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY flag, n, made, tested) - 1 AS INTEGER) AS place, CASE WHEN n % 3 = 0 THEN made || ' && ' || tested ELSE made END AS command,
    'Job ' || flag AS job, CASE WHEN n % 3 = 0 THEN 'Step ' || n ELSE made END AS step, flag FROM s)
SELECT 'w' || k || '.yml' AS path, false AS bad, place, command, job, step, flag || ' ' || job || ' ' || step AS text FROM r
UNION ALL SELECT DISTINCT 'w' || l_orderkey || '.yml', l_orderkey % 10 = 3, CAST(NULL AS INTEGER), NULL, NULL, NULL, '' FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM s)
""")
def workflow_commands(spark, d):
    """Commands of the steps of workflow files, by job and step: names that are quoted or missing, block scalars, steps without a command; files that cannot be read are marked."""
    lines = read_table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    made, tested = F.concat(F.lit("make "), F.col("l_partkey").cast("string")), F.concat(F.lit("test "), F.col("l_suppkey").cast("string"))
    named = F.concat(F.lit("      - name: 'Step "), n.cast("string"), F.lit("'  # two lines\n        run: |\n          "), made, F.lit("\n\n          "), tested, F.lit("\n"))
    step = F.when(n % 3 == 0, named).when(n % 3 == 1, "      - uses: actions/checkout@v4\n        with:\n          depth: 0\n").otherwise(F.concat(F.lit("      - run: "), made, F.lit("\n")))
    jobs = lines.groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), made.alias("m"), tested.alias("t"), step.alias("s")))).alias("steps"))
    text = F.concat(F.lit("  "), F.col("l_returnflag"), F.lit(':\n    name: "Job '), F.col("l_returnflag"), F.lit('"\n    steps:\n'), F.array_join(F.transform("steps", lambda x: x["s"]), ""))
    files = jobs.select("l_orderkey", F.struct("l_returnflag", text.alias("text")).alias("job")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("job")).alias("jobs"))
    head = F.when(F.col("l_orderkey") % 10 == 3, "name: CI\n\tjobs:\n").otherwise("name: CI\non: [push]\njobs:\n")
    path = F.concat(F.lit("w"), F.col("l_orderkey").cast("string"), F.lit(".yml"))
    made_files = files.select(path.alias("path"), F.concat(head, F.array_join(F.transform("jobs", lambda x: x["text"]), "")).alias("text"))
    return workflows.command_candidates(made_files, "path", "text").select("path", "bad", "place", "command", "job", "step", "text")
