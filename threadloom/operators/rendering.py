"""Rendering contexts, backlogs and session summaries to documents.

A document is first a table of lines, each with its place. ``number_lines`` numbers the lines of a
document across tasks: that table has no limit and is the form to save and read back at scale. Only
``assemble_documents`` puts the lines of a document together, for sinks that want one value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.ordering import number_rows, ord_buckets, ord_of
from threadloom.functions.shuffles import cut_lineage


@dataclass(frozen=True)
class Fixed:
    """Lines of a document that do not come from items; ``{goal}`` and ``{stack}`` are filled in.

    ``when`` lists the kinds of item a context must have, or with "!" must not have.
    """

    doc: str
    place: int
    lines: tuple[str, ...]
    when: tuple[str, ...] = ()


@dataclass(frozen=True)
class Listed:
    """Items of one section, one block of lines each."""

    doc: str
    place: int
    section: str
    form: str
    high_only: bool = False


_OVERVIEW, _ARCHITECTURE, _DECISIONS = "context/overview.md", "context/architecture.md", "context/decisions.md"
_CONSTRAINTS, _RISKS, _CRITERIA = "context/constraints.md", "context/risks.md", "context/acceptance-criteria.md"
_SPEC, _TASKS = "work/spec.md", "work/tasks.md"

# ---- Fixed values: headings and placeholders that saved documents are recognised by. -------------

KNOWLEDGE_BASE = (
    Fixed(_OVERVIEW, 1, ("## Goal", "")),
    Fixed(_OVERVIEW, 2, ("{goal}",), ("goal",)),
    Fixed(_OVERVIEW, 2, ("(goal not detected — fill in manually)",), ("!goal",)),
    Fixed(_OVERVIEW, 3, ("", "## Vision", "")),
    Fixed(_OVERVIEW, 4, ("Build the system described above using {stack}.",), ("tech_stack",)),
    Fixed(_OVERVIEW, 4, ("Build the system described above using the chosen tech stack.",), ("!tech_stack",)),
    Fixed(_OVERVIEW, 5, ("", "## Success criteria", "", "See `acceptance-criteria.md` for the explicit definition of done.")),
    Fixed(_ARCHITECTURE, 1, ("## Tech stack", "")),
    Listed(_ARCHITECTURE, 2, "tech_stack", "entry"),
    Fixed(_ARCHITECTURE, 2, ("_No tech stack detected — fill in manually._",), ("!tech_stack",)),
    Fixed(_ARCHITECTURE, 3, ("", "## System design", "")),
    Fixed(_ARCHITECTURE, 4, ("_Add a high-level component diagram and data-flow description here._",), ("tech_stack",)),
    Fixed(_ARCHITECTURE, 4, ("_Document the major components here._",), ("!tech_stack",)),
    Listed(_DECISIONS, 1, "decision", "adr"),
    Fixed(_DECISIONS, 1, ("_No decisions extracted yet._",), ("!decision",)),
    Fixed(_CONSTRAINTS, 1, ("## Constraints", ""), ("constraint",)),
    Listed(_CONSTRAINTS, 2, "constraint", "bullet"),
    Fixed(_CONSTRAINTS, 3, ("",), ("constraint", "non_goal")),
    Fixed(_CONSTRAINTS, 4, ("## Non-goals", ""), ("non_goal",)),
    Listed(_CONSTRAINTS, 5, "non_goal", "bullet"),
    Fixed(_CONSTRAINTS, 6, ("_No constraints or non-goals recorded._",), ("!constraint", "!non_goal")),
    Fixed(_RISKS, 1, ("## Open questions", ""), ("open_question",)),
    Listed(_RISKS, 2, "open_question", "open"),
    Fixed(_RISKS, 3, ("_No open questions or risks recorded._",), ("!open_question",)),
    Fixed(_CRITERIA, 1, ("## Must-have (high-priority tasks)", ""), ("high_task",)),
    Listed(_CRITERIA, 2, "task", "open", high_only=True),
    Fixed(_CRITERIA, 3, ("_No high-priority tasks recorded — define acceptance criteria manually._",), ("!high_task",)),
    Fixed(_SPEC, 1, ("## Goal", "")),
    Fixed(_SPEC, 2, ("{goal}",), ("goal",)),
    Fixed(_SPEC, 2, ("_(see overview.md)_",), ("!goal",)),
    Fixed(_SPEC, 3, ("", "## Tech stack", "")),
    Listed(_SPEC, 4, "tech_stack", "entry"),
    Fixed(_SPEC, 4, ("_TBD_",), ("!tech_stack",)),
    Fixed(_SPEC, 5, ("", "## Tasks", "")),
    Listed(_SPEC, 6, "task", "bullet"),
    Fixed(_SPEC, 6, ("_TBD_",), ("!task",)),
    Listed(_TASKS, 1, "task", "checkbox"),
    Fixed(_TASKS, 1, ("- [ ] _No tasks extracted — add them manually._",), ("!task",)),
)

NO_RATIONALE = "_No rationale recorded._"
NO_DECISION = "_No decision recorded._"
NO_TRADE_OFFS = "_Document the trade-offs here._"

# ---- End of fixed values. ------------------------------------------------------------------------

# Layouts by target; add one to render another set of documents.
LAYOUTS: dict[str, tuple[Fixed | Listed, ...]] = {"knowledge-base": KNOWLEDGE_BASE}

_KINDS = ("goal", "tech_stack", "decision", "task", "constraint", "non_goal", "open_question")


def adr_lines(number: Column) -> list[Column]:
    """Lines of one decision record, after a blank line unless it is the first."""
    title = F.concat(F.format_string("## ADR-%03d — ", number), F.coalesce(T.non_empty(F.col("label")), F.lit("Untitled decision")))
    return [
        F.when(number > 1, F.lit("")), title, F.lit(""), F.lit("**Status:** Accepted"), F.lit(""), F.lit("**Context:**"), F.lit(""),
        F.coalesce(T.non_empty(F.col("detail")), F.lit(NO_RATIONALE)), F.lit(""), F.lit("**Decision:**"), F.lit(""),
        F.coalesce(T.non_empty(F.col("text")), F.lit(NO_DECISION)), F.lit(""), F.lit("**Consequences:**"), F.lit(""), F.lit(NO_TRADE_OFFS),
    ]


def _checkbox() -> list[Column]:
    urgent = F.when(F.col("priority") == "high", " *(high priority)*").otherwise("")
    mark = F.when(F.col("done"), "- [x] ").otherwise("- [ ] ")
    return [F.concat(mark, "text", urgent), F.when(~T.is_blank(F.col("detail")), F.concat(F.lit("  - "), "detail"))]


def item_lines(form: str, number: Column) -> list[Column]:
    """Lines of one item; a null line is left out."""
    text = F.col("text")
    if form == "adr":
        return adr_lines(number)
    if form == "checkbox":
        return _checkbox()
    shown = {
        "bullet": F.concat(F.lit("- "), text),
        "open": F.concat(F.lit("- [ ] "), text),
        "entry": F.concat(F.lit("- **"), T.capitalise(F.col("label")), F.lit("**: "), text),
    }
    return [shown[form]]


def _line(doc: str, place: int, pos: int, line: Column, present: Column) -> Column:
    return F.when(
        present & line.isNotNull(), F.struct(F.lit(doc).alias("rel_path"), F.lit(place).alias("place"), F.lit(pos).alias("pos"), line.alias("line"))
    )


def context_flags(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per context: its goal, its stack in words, and which kinds of item it has."""
    section, text = F.col("section"), F.col("text")
    stack = F.collect_list(F.when((section == "tech_stack") & (text != ""), F.struct("ord", "text")))
    return items.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.when(section == "goal", text), F.when(section == "goal", F.col("ord"))), F.lit("")).alias("_goal_text"),
        F.array_join(F.transform(F.array_sort(stack), lambda s: s["text"]), ", ").alias("_stack_text"),
        *[F.bool_or((section == k) & ((section != "goal") | (text != ""))).alias(f"_has_{k}") for k in _KINDS],
        F.bool_or((section == "task") & (F.col("priority") == "high")).alias("_has_high_task"),
    )


def document_lines(items: DataFrame, layout: Sequence[Fixed | Listed] = KNOWLEDGE_BASE, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """(keys, rel_path, place, ord, pos, line) of every document of every context."""
    keys = list(keys)
    items = cut_lineage(items)  # read several times below

    def fixed(block: Fixed) -> list[Column]:
        present = F.lit(True)
        for kind in block.when:
            flag = F.col(f"_has_{kind.lstrip('!')}")
            present = present & (~flag if kind.startswith("!") else flag)
        filled = [F.replace(F.replace(F.lit(line), F.lit("{goal}"), F.col("_goal_text")), F.lit("{stack}"), F.col("_stack_text")) for line in block.lines]
        return [_line(block.doc, block.place, i, line, present) for i, line in enumerate(filled)]

    blocks = [block for block in layout if isinstance(block, Listed)]
    counted = {block.section for block in blocks if block.form == "adr"}  # only these lines show the number of their item

    def listed(section: str) -> Column:
        out = []
        for block in (b for b in blocks if b.section == section):
            present = F.col("priority") == "high" if block.high_only else F.lit(True)
            out += [_line(block.doc, block.place, i, line, present) for i, line in enumerate(item_lines(block.form, F.col("_n")))]
        return F.when(F.col("section") == section, F.array(*out))

    def lines_of(rows: DataFrame, sections: Sequence[str]) -> DataFrame:
        return rows.select(*keys, "ord", F.explode(F.coalesce(*[listed(s) for s in sections])).alias("l"))

    fixed_lines = [line for block in layout if isinstance(block, Fixed) for line in fixed(block)]
    lines = context_flags(items, keys).select(*keys, ord_of().alias("ord"), F.explode(F.array(*fixed_lines)).alias("l"))
    plain = sorted({block.section for block in blocks} - counted)
    if plain:
        lines = lines.unionByName(lines_of(items.filter(F.col("section").isin(plain)).withColumn("_n", F.lit(None).cast("bigint")), plain))
    if counted:
        own = items.filter(F.col("section").isin(*counted))
        lines = lines.unionByName(lines_of(number_rows(own, [*keys, "section"], ["ord"], ord_buckets(), "_n"), sorted(counted)))
    lines = lines.filter("l IS NOT NULL")
    return lines.select(*keys, "l.rel_path", "l.place", "ord", "l.pos", "l.line")


def number_lines(lines: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """(keys, rel_path, n, line): the lines of every document, counted from 1. No task holds a whole document."""
    group = [*keys, "rel_path"]
    lines = cut_lineage(lines)  # counted, then numbered
    return number_rows(lines, group, ["place", "ord", "pos"], [F.col("place"), *ord_buckets()], "n").select(*group, "n", "line")


def assemble_documents(lines: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """(keys, rel_path, body): one row per document, its lines in order joined by line breaks.

    For the last step before a sink that takes whole documents: a body is one value, so the task that
    writes it holds it. Contexts too large for that stay the table of ``number_lines``.
    """
    listed = F.array_sort(F.collect_list(F.struct("place", "ord", "pos", "line")))
    return lines.groupBy(*keys, "rel_path").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("body"))


def render_documents(items: DataFrame, layout: Sequence[Fixed | Listed] = KNOWLEDGE_BASE, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    return assemble_documents(document_lines(items, layout, keys), keys)


# ---- JSON documents ------------------------------------------------------------------------------


def _json_lines(df: DataFrame, keys: list[str], doc: str, place: int, line: Column, ordered: str = "ord") -> DataFrame:
    return df.select(*keys, F.lit(doc).alias("rel_path"), F.lit(place).alias("place"), F.col(ordered).alias("ord"), F.lit(0).alias("pos"), line.alias("line"))


def _comma(value: Column) -> Column:
    return F.concat(F.when(F.col("_n") > 1, ",").otherwise(""), value)


def context_json_lines(
    items: DataFrame, keys: Sequence[str] = ("project_id",), doc: str = "context.json", fields: Sequence[str] = ("goal", "tech_stack", "tasks", "constraints", "open_questions")
) -> DataFrame:
    """Lines of one JSON document per context, to be put together by ``assemble_documents``."""
    keys = list(keys)
    items = cut_lineage(items)  # read three times below
    text = F.to_json(F.array("text"))
    quoted = F.substr(text, F.lit(2), F.length(text) - 2)
    entry = F.to_json(F.create_map("label", "text"))
    forms = {
        "tech_stack": ("tech_stack", F.substr(entry, F.lit(2), F.length(entry) - 2)),
        "decisions": ("decision", F.to_json(F.struct(F.col("label").alias("topic"), F.col("text").alias("decision"), F.col("detail").alias("rationale")))),
        "tasks": ("task", F.to_json(F.struct(F.col("text").alias("title"), F.col("detail").alias("description"), "priority", "done"))),
        "constraints": ("constraint", quoted),
        "non_goals": ("non_goal", quoted),
        "open_questions": ("open_question", quoted),
    }
    goal = F.to_json(F.array("_goal_text"))
    frame, listed = [], []
    for i, name in enumerate(fields):
        comma = "," if i + 1 < len(fields) else "}"
        start = "{" if i == 0 else ""
        if name == "goal":
            line = F.concat(F.lit(f'{start}"goal":'), F.substr(goal, F.lit(2), F.length(goal) - 2), F.lit(comma))
            frame.append(_line(doc, 3 * i, 0, line, F.lit(True)))
            continue
        section, shown = forms[name]
        opening, closing = "{}" if name == "tech_stack" else "[]"
        frame.append(_line(doc, 3 * i, 0, F.lit(f'{start}"{name}":{opening}'), F.lit(True)))
        frame.append(_line(doc, 3 * i + 2, 0, F.lit(closing + comma), F.lit(True)))
        listed.append(_line(doc, 3 * i + 1, 0, _comma(shown), F.col("section") == section))
    numbered = number_rows(items, [*keys, "section"], ["ord"], ord_buckets(), "_n")
    lines = context_flags(items, keys).select(*keys, ord_of().alias("ord"), F.explode(F.array(*frame)).alias("l"))
    lines = lines.unionByName(numbered.select(*keys, "ord", F.coalesce(*listed).alias("l")))
    return lines.filter("l IS NOT NULL").select(*keys, "l.rel_path", "l.place", "ord", "l.pos", "l.line")


def export_context_json(items: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """(keys, rel_path, body): goal, technologies, tasks, constraints and open questions."""
    return assemble_documents(context_json_lines(items, keys), keys)


def backlog_json_lines(backlog: DataFrame, manifest: DataFrame, key: str = "project_id") -> DataFrame:
    """Lines of one backlog document per project of the manifest: a head, one line per task, an end."""
    doc = "work/backlog.json"
    numbered = number_rows(backlog, [key], ["ord"], ord_buckets(), "_n")
    fields = ["id", "title", "description", "phase", "priority", "done", "tags", "added_at", "done_at"]
    task = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    head = F.to_json(F.struct("schema_version", F.col("generated_at").alias("updated_at"), "project"))
    heads = manifest.withColumn("ord", ord_of())
    return (
        _json_lines(heads, [key], doc, 0, F.concat(F.left(head, F.length(head) - 1), F.lit(',"tasks":[')))
        .unionByName(_json_lines(numbered, [key], doc, 1, _comma(task)))
        .unionByName(_json_lines(heads, [key], doc, 2, F.lit('],"milestones":[]}')))
    )


def backlog_json(backlog: DataFrame, manifest: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, rel_path, body) of one backlog document per project of the manifest."""
    return assemble_documents(backlog_json_lines(backlog, manifest, key), [key])


def build_manifest(items: DataFrame, titles: DataFrame | None, source: str, target: str, version: str, now: str, key: str = "project_id") -> DataFrame:
    """One row per context; the project is its title, else its goal, else a stand-in.

    ``titles`` is (key, title).
    """
    goal = F.max_by(F.when(F.col("section") == "goal", F.col("text")), F.when(F.col("section") == "goal", F.col("ord")))
    contexts = items.groupBy(key).agg(goal.alias("_goal"))
    named = contexts.withColumn("title", F.lit("")) if titles is None else contexts.join(titles, key, "left")
    return named.select(
        key, F.lit("1.0").alias("schema_version"), F.lit(version).alias("version"), F.lit(now).alias("generated_at"), F.lit(source).alias("source"),
        F.lit(target).alias("target"), F.coalesce(T.non_empty(F.col("title"), F.col("_goal")), F.lit("Untitled project")).alias("project"),
    )


# ---- session summaries ---------------------------------------------------------------------------


def session_lines(
    summary: DataFrame, changes: DataFrame, tasks: DataFrame, generated_at: str, project: str = "", key: str = "path", title: str = "Session summary", doc: str = "SESSION.md"
) -> DataFrame:
    """Lines of a summary document per session.

    ``summary`` comes from ``summarise_sessions``, ``changes`` from ``file_changes`` and ``tasks``
    from ``match_plan_tasks``; the two long lists stay tables until the document is assembled.
    """
    one = ord_of()

    def fixed(place: int, *lines: Column | str, when: Column | None = None) -> list[Column]:
        present = F.lit(True) if when is None else when
        return [_line(doc, place, i, F.lit(line) if isinstance(line, str) else line, present) for i, line in enumerate(lines)]

    def listed(place: int, column: str, shown) -> Column:
        return F.transform(
            F.col(column), lambda x, i: F.struct(F.lit(doc).alias("rel_path"), F.lit(place).alias("place"), i.alias("pos"), shown(x, i).alias("line"))
        )

    changed, has_tasks = F.col("files_changed") > 0, F.col("tasks_completed") + F.col("tasks_remaining") > 0
    branch = F.coalesce(T.non_empty(F.col("git_branch")), F.lit("unknown"))
    usage = F.concat(F.lit("**Context used:** ~"), F.col("context_usage_pct").cast("string"), F.lit("%"))
    lines = [
        *fixed(
            1, F.concat(F.lit(f"# {title} — {project}")), "",
            F.concat(F.lit(f"Generated: {generated_at} | Session: `"), F.left("session_id", F.lit(8)), F.lit("`")),
            F.concat(F.lit("Branch: `"), branch, F.lit("` | Started: "), T.date10(F.col("started_at"))), "", "---", "", "## What Was Accomplished", "",
        ),
        *fixed(2, "*(no file changes detected in session)*", when=~changed),
        *fixed(3, "", "---", "", "## Files Changed", ""),
        *fixed(4, "*(none)*", when=~changed),
        *fixed(4, "| File | Action |", "|------|--------|", when=changed),
        *fixed(6, "", "---", "", "## Tasks (matched from PLAN.md)", ""),
        *fixed(7, "*(no PLAN.md found in project directory)*", when=~has_tasks),
        *fixed(9, "", "---", "", "## Decisions Made During Implementation", ""),
        *fixed(10, "*(none extracted — run with LLM enabled or add decisions manually)*", when=F.size("decisions") == 0),
        *fixed(11, "", "---", "", "## Where the Session Ended", "", F.concat(F.lit("**Last action:** "), F.coalesce(T.non_empty(F.col("last_action")), F.lit("unknown")))),
        *fixed(12, usage, when=F.col("context_usage_pct").isNotNull()),
        *fixed(13, "", "---", "", "## Recommended Next Steps", ""),
        *fixed(14, "*(no suggestions — resume from where the session ended)*", when=F.size("next_steps") == 0),
        *fixed(15, "", "---"),
        *fixed(16, "", "## Commands Run", "", "```bash", when=F.size("commands_run") > 0),
        *fixed(18, "```", when=F.size("commands_run") > 0),
    ]
    nested = F.concat(
        F.array(*lines),
        listed(10, "decisions", lambda d, i: F.concat(F.lit("- "), d)),
        listed(14, "next_steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)),
        listed(17, "commands_run", lambda c, i: c),
    )
    heads = summary.select(key, one.alias("ord"), F.explode(nested).alias("l")).filter("l IS NOT NULL").select(key, "l.rel_path", "l.place", "ord", "l.pos", "l.line")
    seq = F.coalesce(F.col("first_at.seq").try_cast("bigint"), F.lit(0))
    where = ord_of(seq=seq, pos=F.col("first_at.pos"))
    done = changes.select(key, where.alias("ord"), F.explode(F.array(
        _line(doc, 2, 0, F.concat(F.lit("- "), T.capitalise(F.col("action")), F.lit(": `"), "file", F.lit("`")), F.lit(True)),
        _line(doc, 5, 0, F.concat(F.lit("| `"), F.col("file"), F.lit("` | "), F.col("action"), F.lit(" |")), F.lit(True)),
    )).alias("l")).select(key, "l.rel_path", "l.place", "ord", "l.pos", "l.line")
    urgent = F.when((F.col("priority") == "high") & ~F.col("done"), " ← **high priority**").otherwise("")
    task = F.concat(F.when(F.col("done"), "- [x] ").otherwise("- [ ] "), "title", urgent)
    todo = tasks.select(
        key, F.lit(doc).alias("rel_path"), F.when(F.col("done"), 7).otherwise(8).alias("place"), ord_of(seq=F.col("ord")).alias("ord"), F.lit(0).alias("pos"), task.alias("line")
    )
    return heads.unionByName(done).unionByName(todo)


def render_session_summary(summary: DataFrame, changes: DataFrame, tasks: DataFrame, generated_at: str, key: str = "path", **options: str) -> DataFrame:
    return assemble_documents(session_lines(summary, changes, tasks, generated_at, key=key, **options), [key])
