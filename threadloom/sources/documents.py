"""Saved documents: reading a knowledge base back, plan checklists, and the document sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.ordering import carry_forward, ord_of
from threadloom.functions.shuffles import cut_lineage, lookup_join

BACKLOG_TASK = (
    "STRUCT<id: STRING, title: STRING, description: STRING, phase: STRING, priority: STRING, done: BOOLEAN, tags: ARRAY<STRING>, added_at: STRING, done_at: STRING>"
)
BACKLOG = (
    f"STRUCT<schema_version: STRING, updated_at: STRING, project: STRING, tasks: ARRAY<{BACKLOG_TASK}>, "
    "milestones: ARRAY<STRUCT<id: STRING, title: STRING, task_ids: ARRAY<STRING>>>>"
)

# ---- Fixed values: forms in which documents are saved. -------------------------------------------
_TASK = r"(?Udm)^- \[([ xX])\] (.+?)(\s+\*\(high priority\)\*)?$"
_ADR = r"(?Udm)^## ADR-\d{3} — (.+)$"
_DECISION = r"(?Uds)\*\*Decision:\*\*\s*\n\n(.+?)(?:\n\n|$)"
_RATIONALE = r"(?Uds)\*\*Context:\*\*\s*\n\n(.+?)(?:\n\n|$)"
_TECH = r"(?Udm)^- \*\*(.+?)\*\*: (.+)$"
_ITEM = r"(?Udm)^- (?:\[ \] )?(.+)$"
_QUESTION = r"(?Udm)^- \[ \] (.+)$"
_CHECK = r"^(?U)\s*-\s*\[([xX ])\]\s+(.+)$"
# ---- End of fixed values. ------------------------------------------------------------------------


_OVERVIEW, _ARCHITECTURE, _DECISIONS = "context/overview.md", "context/architecture.md", "context/decisions.md"
_CONSTRAINTS, _RISKS, _TASKS, _BACKLOG = "context/constraints.md", "context/risks.md", "work/tasks.md", "work/backlog.json"
_EMPTY = {_DECISIONS: "_No decisions extracted", _CONSTRAINTS: "_No constraints or non-goals recorded._", _RISKS: "_No open questions or risks recorded._"}
_LINES_PER_BUCKET = 65_536


def document_rows(docs: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, rel_path, n, sub, line) of whole documents (key, rel_path, body) or of numbered lines
    (key, rel_path, n, line), whose lines may hold line breaks themselves."""
    if "line" in docs.columns:
        return docs.select(key, "rel_path", F.col("n").cast("bigint").alias("n"), F.posexplode(F.split("line", "\n")).alias("sub", "line"))
    return docs.select(key, "rel_path", F.posexplode(F.split("body", "\n")).alias("n", "line")).select(
        key, "rel_path", (F.col("n") + 1).cast("bigint").alias("n"), F.lit(0).alias("sub"), "line"
    )


def _item(key: str, section: str | Column, at: Column, text: Column, label: Column | None = None, detail: Column | None = None, priority: Column | None = None, done: Column | None = None) -> list[Column | str]:
    def given(c: Column | None, name: str) -> Column:
        return (F.lit("") if c is None else c).alias(name)

    return [
        key, (F.lit(section) if isinstance(section, str) else section).alias("section"), ord_of(seq=at["n"], pos=at["sub"]).alias("ord"), given(label, "label"),
        text.alias("text"), given(detail, "detail"), given(priority, "priority"), (F.lit(False) if done is None else done).alias("done"),
    ]


def _joined(where: Column) -> Column:
    """The lines of one block for which ``where`` holds."""
    listed = F.array_sort(F.collect_list(F.when(where, F.struct("n", "sub", "line"))))
    return F.array_join(F.transform(listed, lambda x: x["line"]), "\n")


def _goals(headed: DataFrame, key: str) -> DataFrame:
    """The text under the first goal heading; a heading that ends its document has none."""
    at = F.struct("head.n", "head.sub")
    named = F.col("_name").startswith("Goal")
    below = F.struct("n", "sub") > at
    blocks = headed.filter(F.col("rel_path") == _OVERVIEW).groupBy(key, at.alias("at"), F.col("head.name").alias("_name")).agg(
        _joined(F.col("head.name").startswith("Goal") & below).alias("_text"), F.count(F.lit(1)).alias("_lines")
    )
    first = blocks.groupBy(key).agg(
        F.min_by(F.struct("_text", "_lines"), F.when(named, F.col("at"))).alias("b"), F.min(F.when(named, F.col("at"))).alias("at"), F.max("at").alias("_last")
    )
    kept = first.filter(F.col("at").isNotNull() & ((F.col("b._lines") > 1) | (F.col("at") != F.col("_last"))))
    return kept.select(*_item(key, "goal", F.col("at"), T.strip(F.col("b._text"))))


def _decisions(headed: DataFrame, key: str) -> DataFrame:
    at = F.struct("head.n", "head.sub")
    blocks = headed.filter(F.col("rel_path") == _DECISIONS).groupBy(key, at.alias("at"), F.col("head.name").alias("_name")).agg(
        F.concat(F.lit("\n"), _joined(F.struct("n", "sub") > at)).alias("_text")
    )
    text, why = T.strip(F.regexp_extract("_text", _DECISION, 1)), T.strip(F.regexp_extract("_text", _RATIONALE, 1))
    return blocks.select(*_item(
        key, "decision", F.col("at"), F.when(text == "_No decision recorded._", "").otherwise(text), label=T.strip(F.col("_name")),
        detail=F.when(why == "_No rationale recorded._", "").otherwise(why),
    ))


def _stacks(rows: DataFrame, key: str) -> DataFrame:
    """Each entry at its first place with its last value."""
    at, line = F.struct("n", "sub"), F.col("line")
    entries = rows.filter((F.col("rel_path") == _ARCHITECTURE) & line.rlike(_TECH)).select(
        key, at.alias("at"), F.lower(T.strip(F.regexp_extract("line", _TECH, 1))).alias("_name"), T.strip(F.regexp_extract("line", _TECH, 2)).alias("_value")
    )
    settled = entries.groupBy(key, "_name").agg(F.min("at").alias("at"), F.max_by("_value", "at").alias("_value"))
    return settled.select(*_item(key, "tech_stack", F.col("at"), F.col("_value"), label=F.col("_name")))


def read_knowledge_base(docs: DataFrame, key: str = "project_id") -> DataFrame:
    """Items of saved documents, given whole (key, rel_path, body) or as numbered lines (key, rel_path, n, line).

    Lines are read on their own where they can be; headings are carried to the lines below them across
    tasks, so a document may be of any length. A null body has no items.
    """
    rows = document_rows(docs, key).filter(F.col("rel_path").isin(_OVERVIEW, _ARCHITECTURE, _DECISIONS, _CONSTRAINTS, _RISKS, _TASKS))
    if "line" in docs.columns:
        rows = cut_lineage(rows)  # every kind of item reads them below, and would number the lines again
    path, line, at = F.col("rel_path"), F.col("line"), F.struct("n", "sub")
    marked = F.lit(False)
    for name, marker in _EMPTY.items():
        marked = marked | ((path == name) & line.contains(marker))
    empty = rows.filter(marked).select(F.col(key).alias("_key"), F.col("rel_path").alias("_path")).distinct()
    rows = rows.join(empty, F.col(key).eqNullSafe(F.col("_key")) & (F.col("rel_path") == F.col("_path")), "left_anti")

    is_head = F.when(path == _DECISIONS, line.rlike(_ADR)).otherwise(line.startswith("## ") | ((F.col("n") == 1) & (F.col("sub") == 0)))
    name = F.when(path == _DECISIONS, F.regexp_extract("line", _ADR, 1)).when(line.startswith("## "), F.substr(line, F.lit(4))).otherwise(line)
    under = rows.filter(path.isin(_OVERVIEW, _DECISIONS) | ((path == _CONSTRAINTS) & (is_head | line.rlike(_ITEM))))
    headed = carry_forward(
        under, [key, "rel_path"], ["n", "sub"], F.floor(F.col("n") / _LINES_PER_BUCKET), F.when(is_head, F.struct("n", "sub", name.alias("name"))), "head"
    ).filter("head IS NOT NULL")

    title = F.col("head.name")
    kind = F.when(title.startswith("Constraints"), "constraint").when(title.startswith("Non-goals"), "non_goal")
    listed = headed.filter((path == _CONSTRAINTS) & kind.isNotNull() & line.rlike(_ITEM))
    task = T.strip(F.regexp_extract("line", _TASK, 2))
    priority = F.when(F.regexp_extract("line", _TASK, 3) != "", "high").otherwise("medium")
    found = [
        _goals(headed, key),
        _stacks(rows, key),
        _decisions(headed, key),
        listed.select(*_item(key, kind, at, T.strip(F.regexp_extract("line", _ITEM, 1)))),
        rows.filter((path == _RISKS) & line.rlike(_QUESTION)).select(*_item(key, "open_question", at, T.strip(F.regexp_extract("line", _QUESTION, 1)))),
        rows.filter((path == _TASKS) & line.rlike(_TASK)).select(*_item(key, "task", at, task, priority=priority, done=F.lower(F.regexp_extract("line", _TASK, 1)) == "x")),
    ]
    out = found[0]
    for items in found[1:]:
        out = out.unionByName(items)
    return out


def read_backlog(docs: DataFrame, key: str = "project_id", on_error: str = "raise") -> DataFrame:
    """Backlog rows of saved backlog documents, with defaults for absent fields.

    Documents come whole, or as the numbered lines this library saves (a head, one line per task, an
    end). One that is no JSON is an error, or with ``on_error="skip"`` has no rows.
    """
    own, mode = docs.filter(F.col("rel_path") == _BACKLOG), {"mode": "FAILFAST" if on_error == "raise" else "PERMISSIVE"}
    if "line" in docs.columns:
        # the place is asked inside the expressions, as filters on a line alone move below its numbering
        head = F.when(F.col("n") == 1, F.concat("line", F.lit("]}")))
        heads = own.filter("n = 1").select(key, F.from_json(head, BACKLOG, mode)["updated_at"].alias("updated_at"))
        task = F.from_json(F.when((F.col("n") > 1) & F.col("line").rlike(r"^,?\{"), F.regexp_replace("line", "^,", "")), BACKLOG_TASK, mode)
        tasks = own.filter("n > 1").select(key, (F.col("n") - 2).alias("pos"), task.alias("t")).filter("t IS NOT NULL")
        rows = lookup_join(tasks, heads, [key]).select(key, F.coalesce("updated_at", F.lit("")).alias("updated_at"), "pos", "t")
    else:
        parsed = own.select(key, F.from_json("body", BACKLOG, mode).alias("b"))
        rows = parsed.select(key, F.coalesce("b.updated_at", F.lit("")).alias("updated_at"), F.posexplode("b.tasks").alias("pos", "t"))
    empty = {"id": "", "title": "", "description": "", "phase": "1", "priority": "medium", "added_at": ""}
    filled = [F.coalesce(f"t.{c}", F.lit(v)).alias(c) for c, v in empty.items()]
    return rows.select(
        key, "updated_at", ord_of(seq=F.col("pos")).alias("ord"), *filled, F.coalesce("t.done", F.lit(False)).alias("done"),
        F.coalesce("t.tags", F.array().cast("array<string>")).alias("tags"), F.col("t.done_at").alias("done_at"),
    )


def read_plan_checklist(docs: DataFrame, key: str = "project_id", text: str = "body") -> DataFrame:
    """(key, ord, title, priority, done) of the checkbox lines of a plan, in line order."""
    lines = docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("ord", "line")).filter(F.col("line").rlike(_CHECK))
    return lines.select(
        key, "ord", T.strip(F.regexp_extract("line", _CHECK, 2)).alias("title"), F.lit("medium").alias("priority"),
        (F.lower(F.regexp_extract("line", _CHECK, 1)) == "x").alias("done"),
    )


def write_documents(documents: DataFrame, path: str, overwrite: bool = False, dry_run: bool = False, key: str = "project_id", buckets: int = 64) -> DataFrame:
    """Write whole documents or numbered lines, in folders by hash bucket of the key and sorted inside;
    returns the paths. An existing target is an error unless ``overwrite``; a dry run only returns the plan."""
    plan = documents.select(key, "rel_path").distinct()
    if not dry_run:
        order = ["key_bucket", key, "rel_path", *[c for c in documents.columns if c == "n"]]
        placed = documents.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
        placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)  # a hot key is spread over its ranges
        placed.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("key_bucket").parquet(path)
    return plan
