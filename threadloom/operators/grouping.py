"""Grouping conversations into projects by their titles.

Input is conversations(listing, ord, conv_id, title): a listing is one export, the unit inside which
titles are compared; ``ord`` is the bigint place in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.ordering import top_rows
from threadloom.functions.shuffles import cut_lineage, lookup_join
from threadloom.lexicons import DEFAULT_LEXICON, TITLE_SEPARATOR, TITLE_STOP_WORDS, Lexicon
from threadloom.operators.extraction import extract_items
from threadloom.operators.merging import merge_contexts

UNGROUPED = "(ungrouped)"
_SECOND_POOL = 1 << 61


def tokens_of(title: Column, stop_words: Sequence[str] = TITLE_STOP_WORDS) -> Column:
    return F.array_sort(T.title_tokens(title, stop_words))


def filter_by_project(conversations: DataFrame, name: str, stop_words: Sequence[str] = TITLE_STOP_WORDS) -> DataFrame:
    """Conversations whose title holds every significant token of the name."""
    wanted = T.title_tokens(F.lit(name), stop_words)
    missing = F.array_except(wanted, T.title_tokens(F.col("title"), stop_words))
    return conversations.filter((F.size(wanted) > 0) & (F.size(missing) == 0))


def title_prefix(title: Column) -> Column:
    """Text before the first separator, null when there is none or it is shorter than two."""
    parts = F.split(title, TITLE_SEPARATOR, 2)
    prefix = T.strip(F.get(parts, F.lit(0)))
    return F.when((F.size(parts) >= 2) & (F.length(prefix) >= 2), prefix)


def prefix_projects(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grouped, rest): titles that share a prefix with another one, and all others.

    The rest has ``idx``, the order in which it is compared on: titles without a prefix first.
    """
    rows = conversations.withColumn("_prefix", title_prefix(F.col("title")))
    prefixed = rows.filter("_prefix IS NOT NULL")
    singles = (
        prefixed.groupBy("listing", "_prefix").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).filter("n = 1").select("listing", "ord")
    )
    grouped = prefixed.join(singles, ["listing", "ord"], "left_anti").withColumnRenamed("_prefix", "project")
    back = prefixed.join(singles, ["listing", "ord"], "left_semi").withColumn("idx", F.col("ord") + F.lit(_SECOND_POOL))
    rest = rows.filter("_prefix IS NULL").withColumn("idx", F.col("ord")).unionByName(back)
    return grouped, rest.drop("_prefix")


def _pair_keys() -> Column:
    """Hashable key of every two tokens of a title."""
    count = F.size("tokens")
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.transform(
                F.slice("tokens", i + 1, count), lambda later: F.concat_ws(" ", F.element_at("tokens", i), later)
            ),
        )
    )


def token_projects(rest: DataFrame) -> DataFrame:
    """(listing, idx, leader, shared): titles taken by a leader title they share two tokens with.

    In title order, a free title leads all later free titles that share two tokens with it, if one
    token is common to them all; else it stays alone. Titles are tied together through their token
    pairs, never pairwise with each other. In each round every title that no earlier one within two
    steps can affect settles at once, by aggregates on (listing, token pair). Rounds follow each
    other only along chains of titles that wait for one another.
    """
    live = cut_lineage(
        rest.select("listing", "idx", tokens_of(F.col("title")).alias("tokens")).filter(F.size("tokens") >= 2)
    )
    settled: list[DataFrame] = []
    while True:
        pairs = live.select("listing", "idx", F.explode(_pair_keys()).alias("pair"))
        firsts = (
            pairs.groupBy("listing", "pair").agg(F.min("idx").alias("first"), F.max("idx").alias("_max")).filter(F.col("first") < F.col("_max")).drop("_max")
        )
        near = lookup_join(pairs, firsts, ["listing", "pair"])
        earliest = near.groupBy("listing", "idx").agg(F.min("first").alias("earliest"))
        tied = cut_lineage(near.drop("first").join(earliest, ["listing", "idx"]))
        beyond = tied.groupBy("listing", "pair").agg(F.min("earliest").alias("beyond"))
        horizon = (
            lookup_join(tied.select("listing", "pair", "idx", "earliest"), beyond, ["listing", "pair"])
            .groupBy("listing", "idx")
            .agg(F.first("earliest").alias("earliest"), F.min("beyond").alias("beyond"))
        )
        state = cut_lineage(live.join(horizon, ["listing", "idx"]))
        if state.isEmpty():
            break
        leaders = state.filter("beyond = idx").select("listing", F.col("idx").alias("leader"))
        members = lookup_join(state.withColumnRenamed("earliest", "leader").drop("beyond"), leaders, ["listing", "leader"])
        sizes = members.groupBy("listing", "leader").agg(F.count(F.lit(1)).alias("size"))
        held = members.select("listing", "leader", F.explode("tokens").alias("token")).groupBy("listing", "leader", "token").agg(F.count(F.lit(1)).alias("n"))
        common = (
            held.join(sizes, ["listing", "leader"]).filter("n = size").groupBy("listing", "leader").agg(F.array_sort(F.collect_list("token")).alias("shared"))
        )
        accepted = lookup_join(members.select("listing", "idx", "leader"), common, ["listing", "leader"])
        accepted = cut_lineage(accepted)
        settled.append(accepted)
        done = leaders.select("listing", F.col("leader").alias("idx")).unionByName(accepted.select("listing", "idx")).distinct()
        live = cut_lineage(state.select("listing", "idx", "tokens").join(done, ["listing", "idx"], "left_anti"))
    if not settled:
        none = rest.filter(F.lit(False))
        return none.select("listing", "idx", F.col("idx").alias("leader"), tokens_of(F.col("title")).alias("shared"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def group_by_project(conversations: DataFrame) -> DataFrame:
    """Conversations with ``project`` and ``leader``, the first title of a token-overlap project.

    Two token projects may come to the same name; ``leader`` tells them apart and no row is lost.
    """
    grouped, rest = prefix_projects(conversations)
    clusters = token_projects(rest)
    name = T.title_case(F.array_join("shared", " "))
    placed = rest.join(clusters, ["listing", "idx"], "left").withColumn("project", F.coalesce(name, F.lit(UNGROUPED)))
    columns = [*conversations.columns, "project", "leader"]
    return grouped.withColumn("leader", F.lit(None).cast("bigint")).select(columns).unionByName(placed.select(columns))


def project_listing(grouped: DataFrame) -> DataFrame:
    """(listing, project, n)."""
    return grouped.groupBy("listing", "project").agg(F.count(F.lit(1)).alias("n"))


def conversation_page(conversations: DataFrame, limit: int = 20) -> DataFrame:
    """First conversations of every listing and how many more there are."""
    page = top_rows(conversations, ["listing"], [F.col("ord")], limit)
    totals = conversations.groupBy("listing").agg(F.count(F.lit(1)).alias("total"))
    more = F.greatest(F.col("total") - limit, F.lit(0)).alias("more")
    # a page holds at most ``limit`` rows per listing: no heavy key is left to join
    return page.join(totals, "listing").select(
        "listing", "rank", F.left("conv_id", F.lit(12)).alias("conv_id"), T.date10(F.col("date")).alias("date"), "title", "total", more
    )


def merge_project(messages: DataFrame, conversations: DataFrame, name: str, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Merged context of the conversations of one project; none unless two of them have messages.

    Sessions are merged in listing order.
    """
    chosen = filter_by_project(conversations, name).select("conv_id", "listing", F.col("ord").alias("session_ord"))
    own = lookup_join(messages, chosen.select("conv_id").distinct(), ["conv_id"], "left_semi")
    items = lookup_join(extract_items(own, lexicon), chosen, ["conv_id"])
    merged = merge_contexts(items.withColumn("project_id", F.col("listing")))
    spans = items.groupBy("listing").agg((F.min("conv_id") < F.max("conv_id")).alias("several")).filter("several")
    return lookup_join(merged, spans.select(F.col("listing").alias("project_id")), ["project_id"], "left_semi")
