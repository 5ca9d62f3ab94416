"""Project grouping by titles over part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.lexicons import TITLE_STOP_WORDS
from threadloom.operators import grouping as G
from threadloom.plans.inputs import LEXICON, messages, quoted
from threadloom.plans.registry import query, table


def titled_parts(spark, sf_dir) -> DataFrame:
    """Parts as conversations: every third title has its type as a prefix, some prefixes are unique."""
    key, name = F.col("p_partkey"), F.col("p_name")
    title = (
        F.when(key % 3 == 0, F.concat(F.col("p_type"), F.lit("type - "), name))
        .when(key % 50 == 1, F.concat(F.lit("only"), key, F.lit(": "), name))
        .otherwise(name)
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("L"), F.col("p_size") % 4).alias("listing"), key.alias("ord"), key.cast("string").alias("conv_id"), title.alias("title"),
        F.when(key % 4 > 0, F.concat(F.lit("2024-01-02T00:00:"), key)).alias("date"),
    )


_PARTS = (
    "c AS (SELECT 'L' || (p_size % 4) AS listing, p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS conv_id, "
    "CASE WHEN p_partkey % 3 = 0 THEN p_type || 'type - ' || p_name WHEN p_partkey % 50 = 1 THEN 'only' || p_partkey || ': ' || p_name ELSE p_name END AS title, "
    "CASE WHEN p_partkey % 4 > 0 THEN '2024-01-02T00:00:' || p_partkey END AS date, p_name FROM part)"
)
_STOP = "[" + ", ".join(quoted(w) for w in TITLE_STOP_WORDS) + "]"
_TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))))"
_PREFIX = "pre AS (SELECT *, CASE WHEN regexp_matches(title, '[-—:|/]') THEN trim(regexp_extract(title, '^(.*?)\\s*[-—:|/]', 1)) END AS prefix FROM c)"
_SPLIT = (
    f"{_PREFIX}, sized AS (SELECT *, CASE WHEN length(prefix) >= 2 THEN count(*) OVER (PARTITION BY listing, prefix) END AS n FROM pre)"
)


@query("a5_prefix_projects", f"WITH {_PARTS}, {_SPLIT} SELECT listing, conv_id, CASE WHEN n >= 2 THEN prefix END AS project FROM sized")
def _(spark, sf_dir):
    grouped, rest = G.prefix_projects(titled_parts(spark, sf_dir))
    return grouped.select("listing", "conv_id", "project").unionByName(rest.select("listing", "conv_id", F.lit(None).cast("string").alias("project")))


# Names are two words, and a third token ("only17", or a type that no other title of the listing has)
# is never shared, so titles share two tokens exactly when their names are the same words.
_GROUPS = (
    f"{_SPLIT}, pool AS (SELECT listing, ord, conv_id, p_name, CASE WHEN prefix IS NULL OR length(prefix) < 2 THEN ord ELSE ord + (1::BIGINT << 61) END AS idx "
    "FROM sized WHERE n IS NULL OR n < 2), "
    "core AS (SELECT *, list_sort(string_split(lower(p_name), ' ')) AS pair FROM pool), "
    "led AS (SELECT *, min(idx) OVER (PARTITION BY listing, pair) AS leader, count(*) OVER (PARTITION BY listing, pair) AS members FROM core), "
    "placed AS (SELECT listing, conv_id, CASE WHEN members >= 2 THEN array_to_string(list_transform(pair, lambda t: upper(left(t, 1)) || substr(t, 2)), ' ') ELSE '(ungrouped)' END AS project FROM led "
    "UNION ALL SELECT listing, conv_id, prefix FROM sized WHERE n >= 2)"
)


@query("g1_group_by_project", f"WITH {_PARTS}, {_GROUPS} SELECT * FROM placed")
def _(spark, sf_dir):
    return G.group_by_project(titled_parts(spark, sf_dir)).select("listing", "conv_id", "project")


@query("g2_project_listing", f"WITH {_PARTS}, {_GROUPS} SELECT listing, project, count(*) AS n FROM placed GROUP BY 1, 2")
def _(spark, sf_dir):
    return G.project_listing(G.group_by_project(titled_parts(spark, sf_dir)))


@query("u3_token_intersection", (
    f"WITH {_PARTS}, {_GROUPS} SELECT listing, leader, array_to_string(pair, ' ') AS shared, count(*) AS n FROM led WHERE members >= 2 GROUP BY ALL"
))
def _(spark, sf_dir):
    _, rest = G.prefix_projects(titled_parts(spark, sf_dir))
    taken = G.token_projects(rest).withColumn("shared", F.array_join("shared", " "))
    return taken.groupBy("listing", "leader", "shared").agg(F.count(F.lit(1)).alias("n"))


@query("u5_subset_test", f"WITH {_PARTS} SELECT conv_id FROM c WHERE list_has_all({_TOKENS}, ['gear'])")
def _(spark, sf_dir):
    return G.filter_by_project(titled_parts(spark, sf_dir), "a gear").select("conv_id")


@query("p5_filter_by_project", f"WITH {_PARTS} SELECT conv_id, title FROM c WHERE list_has_all({_TOKENS}, ['bolt', 'red'])")
def _(spark, sf_dir):
    return G.filter_by_project(titled_parts(spark, sf_dir), "The Red bolt").select("conv_id", "title")


@query("t7_conversation_page", (
    f"WITH {_PARTS}, r AS (SELECT listing, row_number() OVER (PARTITION BY listing ORDER BY ord) AS rank, left(conv_id, 12) AS conv_id, coalesce(left(date, 10), 'unknown') AS date, title, "
    "count(*) OVER (PARTITION BY listing) AS total FROM c) SELECT *, greatest(total - 20, 0) AS more FROM r WHERE rank <= 20"
))
def _(spark, sf_dir):
    page = G.conversation_page(titled_parts(spark, sf_dir))
    return page.withColumn("rank", F.col("rank").cast("bigint"))


@query("f6_py_title", "SELECT p_partkey, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || p_size || 'D' AS name FROM part")
def _(spark, sf_dir):
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" "), F.col("p_size"), F.lit("d"))
    return table(spark, sf_dir, "part").select("p_partkey", T.title_case(name).alias("name"))


@query("f7_project_hash", "SELECT page_id, replace(replace(url, '/', '-'), '_', '-') AS hash FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.project_hash(F.col("url")).alias("hash"))


@query("f12_date10", f"WITH {_PARTS} SELECT conv_id, coalesce(left(date, 10), 'unknown') AS day FROM c")
def _(spark, sf_dir):
    return titled_parts(spark, sf_dir).select("conv_id", T.date10(F.col("date")).alias("day"))


@query("g3_merge_project")
def _(spark, sf_dir):
    """All conversations are one listing here; every other title names the project."""
    rows = messages(spark, sf_dir).withColumn("conv_id", F.col("conv_id").cast("string"))
    named = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("L").alias("listing"), F.col("conv_id").cast("bigint").alias("ord"), "conv_id",
        F.when(F.col("n") % 2 == 0, "Red project: talk").otherwise("Something else").alias("title"),
    )
    merged = G.merge_project(rows, named, "red project", LEXICON)
    return merged.select("project_id", "section", F.col("ord.src").alias("session"), F.col("ord.seq").alias("seq"), "label", "text")
