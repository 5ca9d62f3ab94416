"""Chat-export readers: files(path, content) to messages, for every supported export format.

A file may hold many conversations; all of them are read. Message order is settled inside the row
that holds the conversation, before it is exploded, so no reader shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T

MESSAGE_COLUMNS = [
    "source", "path", "conv_id", "title", "seq", "role", "content", "timestamp", "message_id",
]

_CLAUDE_MESSAGE = (
    "STRUCT<uuid: STRING, id: STRING, sender: STRING, role: STRING, text: STRING, "
    "content: STRING, created_at: STRING>"
)
_CLAUDE_CONVERSATION = (
    "STRUCT<uuid: STRING, id: STRING, name: STRING, created_at: STRING, "
    f"chat_messages: ARRAY<{_CLAUDE_MESSAGE}>, messages: ARRAY<{_CLAUDE_MESSAGE}>>"
)
_CHATGPT_NODE = (
    "STRUCT<parent: STRING, children: ARRAY<STRING>, message: STRUCT<author: STRUCT<role: STRING>, "
    "content: STRUCT<parts: ARRAY<VARIANT>>, create_time: STRING>>"
)
_CHATGPT_EXPORT = (
    "ARRAY<STRUCT<id: STRING, title: STRING, create_time: STRING, "
    f"mapping: MAP<STRING, {_CHATGPT_NODE}>>>"
)
_GEMINI_BODY = "STRUCT<parts: ARRAY<STRUCT<text: STRING>>>"
_GEMINI_EXPORT = (
    "STRUCT<appActivity: ARRAY<STRUCT<activityTime: STRING, "
    f"requestBody: {_GEMINI_BODY}, responseBody: {_GEMINI_BODY}>>>"
)
_PERPLEXITY_EXPORT = (
    "STRUCT<conversations: ARRAY<STRUCT<id: STRING, title: STRING, messages: ARRAY<STRUCT<"
    "role: STRING, content: STRING, timestamp: STRING, "
    "sources: ARRAY<STRUCT<title: STRING, url: STRING>>>>>>>"
)

_MARKDOWN_HEADER = r"(?Udm)^\*\*(Human|Assistant):\*\*\s*"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole export files as rows (path, content)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSONL files as rows (path, line); files are split, no file is read whole."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def files_where(files: DataFrame, condition: Column) -> DataFrame:
    """Files of one kind, with the content of all others blanked as well as filtered out.

    Parsing may raise, and Catalyst may evaluate it before a filter it was written after. On null
    content it has nothing to raise about.
    """
    return files.withColumn("content", F.when(condition, F.col("content"))).filter(condition)


def classify_exports(files: DataFrame) -> DataFrame:
    """Source of every file by extension and by markers in its first 500 characters."""
    head = F.left("content", F.lit(500))
    kind = suffix(F.col("path"))

    def has(*markers: str) -> Column:
        return T.contains_any(head, markers)

    source = (
        F.when(kind == ".jsonl", "claude")
        .when((kind == ".md") & has("**Human:**", "**Assistant:**"), "claude")
        .when(
            kind == ".json",
            F.when(has('"uuid"', '"chat_messages"'), "claude")
            .when(has('"mapping"') & has('"author"'), "chatgpt")
            .when(has('"appActivity"', "Gemini Apps"), "gemini")
            .when(
                has('"conversations"')
                & (has('"sources"') | file_name(F.col("path")).startswith("perplexity_")),
                "perplexity",
            ),
        )
    )
    error = F.when(
        F.col("source").isNull(),
        F.when(
            F.col("_kind").isin(".json", ".md"),
            F.concat(F.lit("Could not auto-detect source from "), file_name(F.col("path"))),
        ).otherwise(F.concat(F.lit("Unsupported file extension "), F.col("_kind"))),
    )
    return (
        files.withColumn("_kind", kind)
        .withColumn("source", source)
        .withColumn("error", error)
        .drop("_kind")
    )


def _demand(condition: Column, message: str, on_error: str) -> Column:
    """Filter that raises on the first bad row, or with ``on_error="skip"`` leaves it out."""
    held = F.coalesce(condition, F.lit(False))
    if on_error == "skip":
        return held
    return F.when(held, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def normalised_role(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.isin("human", "user"), "user").when(low == "assistant", "assistant")


def _claude_messages(raw: Column, on_error: str) -> Column:
    """Array of messages in time order; ties and missing times keep their place."""

    def message(m: Column, pos: Column) -> Column:
        raw_role = T.non_empty(m["sender"], m["role"])
        role = normalised_role(raw_role)
        if on_error == "raise":
            role = F.coalesce(role, F.raise_error(F.lit("Unknown role in Claude export")).cast("string"))
        return F.struct(
            F.coalesce(m["created_at"], F.lit("")).alias("ts"),
            pos.alias("pos"),
            role.alias("role"),
            F.coalesce(T.non_empty(m["text"], m["content"]), F.lit("")).alias("content"),
            m["created_at"].alias("timestamp"),
            T.non_empty(m["uuid"], m["id"]).alias("message_id"),
        )

    built = F.filter(F.transform(raw, message), lambda m: (m["content"] != "") & m["role"].isNotNull())
    return F.array_sort(built)


def _explode_messages(df: DataFrame, source: str, messages: Column) -> DataFrame:
    """One row per message of an array column; ``df`` has path, conv_id and title."""
    return df.select(
        F.lit(source).alias("source"), "path", "conv_id", "title", F.posexplode(messages).alias("seq", "m")
    ).select(
        "source", "path", "conv_id", "title", F.col("seq").cast("bigint").alias("seq"),
        F.col("m.role").alias("role"), F.col("m.content").alias("content"),
        F.col("m.timestamp").alias("timestamp"), F.col("m.message_id").alias("message_id"),
    )


def _mode(on_error: str) -> dict[str, str]:
    """Parser options: a malformed record raises, or with ``on_error="skip"`` its unreadable fields are null."""
    return {"mode": "FAILFAST" if on_error == "raise" else "PERMISSIVE"}


def _claude_conversations(files: DataFrame, on_error: str = "raise") -> DataFrame:
    """(path, pos, in_array, conv) of object and array exports."""
    bare = T.strip(F.col("content"))
    as_array = F.when(bare.startswith("["), bare).otherwise(F.concat(F.lit("["), bare, F.lit("]")))
    parsed = F.from_json(as_array, f"ARRAY<{_CLAUDE_CONVERSATION}>", _mode(on_error))
    return files.select(
        "path", bare.startswith("[").alias("in_array"), F.posexplode(parsed).alias("pos", "conv")
    )


def _claude_id() -> Column:
    return F.coalesce(
        T.non_empty(F.col("conv.uuid"), F.col("conv.id")), F.concat_ws("#", "path", "pos")
    )


def read_claude_json(files: DataFrame, on_error: str = "raise") -> DataFrame:
    """One conversation object, or an array of them; sender/text and role/content forms."""
    chat, plain = F.col("conv.chat_messages"), F.col("conv.messages")
    raw = F.when(F.col("in_array") | (F.coalesce(F.size(chat), F.lit(0)) > 0), chat).otherwise(plain)
    conversations = _claude_conversations(files, on_error).select(
        "path", _claude_id().alias("conv_id"), F.coalesce("conv.name", F.lit("")).alias("title"), raw.alias("raw")
    )
    return _explode_messages(conversations, "claude", _claude_messages(F.col("raw"), on_error))


def read_claude_jsonl(lines: DataFrame, on_error: str = "raise") -> DataFrame:
    """One conversation per line; blank lines are skipped and a bad line is an error."""
    parsed = (
        lines.filter(T.strip(F.col("line")) != "")
        .select("path", F.from_json("line", _CLAUDE_CONVERSATION, _mode(on_error)).alias("conv"))
        .select(
            "path",
            T.non_empty(F.col("conv.uuid"), F.col("conv.id")).alias("conv_id"),
            F.coalesce("conv.name", F.lit("")).alias("title"),
            F.col("conv.chat_messages").alias("raw"),
        )
    )
    return _explode_messages(parsed, "claude", _claude_messages(F.col("raw"), on_error))


def read_claude_markdown(files: DataFrame) -> DataFrame:
    """Turns under ``**Human:**`` and ``**Assistant:**`` headers; text before the first is dropped."""
    heads = F.regexp_extract_all("content", F.lit(_MARKDOWN_HEADER), F.lit(1))
    bodies = F.split("content", _MARKDOWN_HEADER)
    turns = F.transform(
        heads,
        lambda head, i: F.struct(
            normalised_role(head).alias("role"),
            T.strip(F.get(F.col("bodies"), i + 1)).alias("content"),
            F.lit(None).cast("string").alias("timestamp"),
            F.lit(None).cast("string").alias("message_id"),
        ),
    )
    df = files.select("path", F.col("path").alias("conv_id"), F.lit("").alias("title"), "content", bodies.alias("bodies"))
    return _explode_messages(df, "claude", F.filter(turns, lambda m: m["content"] != ""))


def _part_text(part: Column) -> Column:
    """Text of a message part: a string as it is, any other value as JSON, empty values as null."""
    kind = F.schema_of_variant(part)
    shown = F.when(kind == "STRING", F.try_variant_get(part, "$", "string")).otherwise(F.to_json(part))
    return F.when(~shown.isin("", "0", "0.0", "false", "null", "[]", "{}") | ((kind == "STRING") & (shown != "")), shown)


def _active_part_text(part: Column) -> Column:
    return F.coalesce(
        F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(part, "$", "string")).otherwise(
            F.try_variant_get(part, "$.text", "string")
        ),
        F.lit(""),
    )


def _walk(ids: list[str], parents: list[str | None], children: list[list[str] | None], active_only: bool) -> list[int]:
    """Places of the nodes in pre-order from the root; each node once, also in a cycle."""
    place = {node: at for at, node in enumerate(ids)}
    stack = [at for at, parent in enumerate(parents) if not parent or parent not in place][:1]
    seen: dict[int, None] = {}
    while stack:
        at = stack.pop()
        if at in seen:
            continue
        seen[at] = None
        below = children[at] or []
        stack += [place[c] for c in reversed(below[-1:] if active_only else below) if c in place]
    return list(seen)


def _visit_order(mapping: Column, active_only: bool) -> Column:
    """Places of a mapping's nodes in pre-order from the root, over all branches or along the last child only.

    Linear in the nodes, of any depth. A node that two parents name, or a cycle, is visited once; a
    branch ends where its last child is unknown. No root: no nodes.
    """

    @F.arrow_udf("array<int>")
    def order(ids: pa.Array, parents: pa.Array, children: pa.Array) -> pa.Array:
        columns = (ids.to_pylist(), parents.to_pylist(), children.to_pylist())
        return pa.array([None if row[0] is None else _walk(*row, active_only) for row in zip(*columns)], pa.list_(pa.int32()))

    nodes = F.map_values(mapping)
    return order(F.map_keys(mapping), F.transform(nodes, lambda n: n["parent"]), F.transform(nodes, lambda n: n["children"]))


def _chatgpt_conversations(files: DataFrame, on_error: str = "raise") -> DataFrame:
    parsed = F.from_json("content", _CHATGPT_EXPORT, _mode(on_error))
    return files.select("path", F.explode(parsed).alias("conv")).select(
        "path",
        F.coalesce("conv.id", F.lit("")).alias("conv_id"),
        F.coalesce("conv.title", F.lit("Untitled")).alias("title"),
        F.col("conv.create_time").alias("create_time"),
        F.col("conv.mapping").alias("mapping"),
    )


def _tree_messages(df: DataFrame, build: Callable[[Column], Column], active_only: bool) -> DataFrame:
    walked = df.select("path", "conv_id", "title", "mapping", _visit_order(F.col("mapping"), active_only).alias("ids"))
    messages = F.filter(
        F.transform("ids", lambda i: build(F.get(F.map_values("mapping"), i)["message"])),
        lambda m: m["role"].isNotNull() & (m["content"] != ""),
    )
    return _explode_messages(walked, "chatgpt", messages)


def read_chatgpt_tree(files: DataFrame, on_error: str = "raise") -> DataFrame:
    """Message trees, depth first over all branches; system and tool turns are left out."""

    def build(m: Column) -> Column:
        role = F.coalesce(m["author"]["role"], F.lit(""))
        parts = F.filter(F.transform(m["content"]["parts"], _part_text), lambda p: p.isNotNull())
        when = m["create_time"]
        return F.struct(
            F.when(role.isin("system", "tool") | m.isNull(), None)
            .when(role == "user", "user")
            .otherwise("assistant")
            .alias("role"),
            F.coalesce(F.array_join(parts, "\n"), F.lit("")).alias("content"),
            F.when(~T.is_blank(when) & (when.try_cast("double").isNull() | (when.try_cast("double") != 0)), T.unix_to_iso(when)).alias("timestamp"),
            F.lit(None).cast("string").alias("message_id"),
        )

    conversations = _chatgpt_conversations(files, on_error)
    empty = F.coalesce(F.size("mapping"), F.lit(0)) > 0
    conversations = conversations.filter(_demand(empty, "No 'mapping' key found in conversation", on_error))
    return _tree_messages(conversations, build, active_only=False)


def read_chatgpt_active_branch(files: DataFrame, on_error: str = "raise") -> DataFrame:
    """Message trees along the most recent branch only; user and assistant turns."""

    def build(m: Column) -> Column:
        role = m["author"]["role"]
        text = F.array_join(F.transform(m["content"]["parts"], _active_part_text), "\n")
        iso = T.unix_to_iso(m["create_time"])
        return F.struct(
            F.when(role.isin("user", "assistant"), role).alias("role"),
            F.coalesce(T.strip(text), F.lit("")).alias("content"),
            F.when(
                m["create_time"].try_cast("double") != 0,
                F.concat(F.rpad(F.left(F.replace(iso, F.lit("+00:00"), F.lit(".000")), F.lit(23)), 23, "0"), F.lit("Z")),
            ).alias("timestamp"),
            F.lit(None).cast("string").alias("message_id"),
        )

    return _tree_messages(_chatgpt_conversations(files, on_error), build, active_only=True)


def read_gemini(files: DataFrame, on_error: str = "raise") -> DataFrame:
    """Activity items: a user row and an assistant row each, when they have text."""

    def turn(item: Column, body: str, role: str) -> Column:
        texts = F.filter(F.transform(item[body]["parts"], lambda p: p["text"]), lambda t: ~T.is_blank(t))
        return F.struct(
            F.lit(role).alias("role"),
            F.coalesce(F.array_join(texts, "\n"), F.lit("")).alias("content"),
            item["activityTime"].alias("timestamp"),
            F.lit(None).cast("string").alias("message_id"),
        )

    parsed = files.select(
        "path", F.col("path").alias("conv_id"), F.lit("").alias("title"),
        F.from_json("content", _GEMINI_EXPORT, _mode(on_error))["appActivity"].alias("items"),
        F.col("content").isNull().alias("absent"),
    ).filter(_demand(F.col("items").isNotNull() | F.col("absent"), "Expected 'appActivity' key", on_error))
    turns = F.flatten(
        F.transform("items", lambda i: F.array(turn(i, "requestBody", "user"), turn(i, "responseBody", "assistant")))
    )
    return _explode_messages(parsed, "gemini", F.filter(turns, lambda m: m["content"] != ""))


def _perplexity_conversations(files: DataFrame, on_error: str) -> DataFrame:
    parsed = files.select(
        "path", F.from_json("content", _PERPLEXITY_EXPORT, _mode(on_error))["conversations"].alias("convs"),
        F.col("content").isNull().alias("absent"),
    ).filter(_demand(F.col("convs").isNotNull() | F.col("absent"), "Expected 'conversations' key", on_error))
    return parsed.select("path", F.explode("convs").alias("conv")).select(
        "path",
        F.coalesce("conv.id", F.lit("")).alias("conv_id"),
        F.coalesce("conv.title", F.lit("Untitled")).alias("title"),
        F.col("conv.messages").alias("raw"),
    )


def read_perplexity(files: DataFrame, on_error: str = "raise") -> DataFrame:
    """Conversations whose sources follow the answer as an assistant message of their own."""

    def link(s: Column) -> Column:
        title = F.coalesce(s["title"], F.lit("Link"))
        return F.when(T.is_blank(s["url"]), F.concat(F.lit("- "), title)).otherwise(
            F.concat(F.lit("- ["), title, F.lit("]("), s["url"], F.lit(")"))
        )

    def pair(m: Column) -> Column:
        role = F.when(m["role"] == "user", "user").otherwise("assistant")
        content = F.coalesce(T.strip(m["content"]), F.lit(""))
        listed = (content != "") & (role == "assistant") & (F.coalesce(F.size(m["sources"]), F.lit(0)) > 0)
        links = F.concat(F.lit("Sources:\n"), F.array_join(F.transform(m["sources"], link), "\n"))

        def row(text: Column) -> Column:
            return F.struct(
                role.alias("role"),
                F.coalesce(text, F.lit("")).alias("content"),
                T.non_empty(m["timestamp"]).alias("timestamp"),
                F.lit(None).cast("string").alias("message_id"),
            )

        return F.array(row(content), row(F.when(listed, links)))

    turns = F.filter(F.flatten(F.transform("raw", pair)), lambda m: m["content"] != "")
    return _explode_messages(_perplexity_conversations(files, on_error), "perplexity", turns)


def list_conversations(files: DataFrame, on_error: str = "raise") -> DataFrame:
    """(source, path, conv_id, title, date) of every conversation in classified files.

    Gemini exports have no listing. JSONL files come as whole files here. Malformed records raise, or
    with ``on_error="skip"`` are listed with what can be read of them.
    """
    source, kind = F.col("source"), suffix(F.col("path"))
    as_objects = _claude_conversations(files_where(files, (source == "claude") & (kind == ".json")), on_error).select("path", "conv")
    as_lines = (
        files_where(files, (source == "claude") & (kind == ".jsonl"))
        .select("path", F.explode(F.split("content", "\n")).alias("line"))
        .filter(T.strip(F.col("line")) != "")
        .select("path", F.from_json("line", _CLAUDE_CONVERSATION, _mode(on_error)).alias("conv"))
    )
    claude_rows = as_objects.unionByName(as_lines).select(
        F.lit("claude").alias("source"), "path",
        F.coalesce("conv.uuid", F.lit("")).alias("conv_id"),
        F.coalesce("conv.name", F.lit("(untitled)")).alias("title"),
        F.coalesce("conv.created_at", F.lit("")).alias("date"),
    )
    created = F.col("create_time")
    chatgpt_rows = _chatgpt_conversations(files_where(files, source == "chatgpt"), on_error).select(
        F.lit("chatgpt").alias("source"), "path", "conv_id", "title",
        F.when(T.is_blank(created) | (created.try_cast("double") == 0), "").otherwise(T.unix_to_iso(created)).alias("date"),
    )
    perplexity_rows = _perplexity_conversations(files_where(files, source == "perplexity"), "skip").select(
        F.lit("perplexity").alias("source"), "path", "conv_id", "title",
        F.coalesce(F.get("raw", F.lit(0))["timestamp"], F.lit("")).alias("date"),
    )
    return claude_rows.unionByName(chatgpt_rows).unionByName(perplexity_rows)


def format_version(files: DataFrame) -> DataFrame:
    """Format label of classified files; files of agent sessions are labelled by their own reader."""
    kind = suffix(F.col("path"))
    first = F.left(T.strip(F.col("content")), F.lit(1))
    keys = F.json_object_keys("content")
    claude = (
        F.when(kind == ".jsonl", "bulk-jsonl v1.0")
        .when(
            kind == ".json",
            F.when(~T.parses_as_json(F.col("content")), "unknown")
            .when(first == "[", "bulk-json v1.0")
            .when(F.array_contains(keys, "chat_messages"), "single-json v1.0")
            .when(F.array_contains(keys, "messages"), "single-json v2.0"),
        )
        .when(kind == ".md", "markdown v1.0")
    )
    version = (
        F.when(F.col("source") == "claude", claude)
        .when(F.col("source") == "chatgpt", "chatgpt-json v1.0")
        .when(F.col("source") == "gemini", "gemini-takeout v1.0")
        .when(F.col("source") == "perplexity", "perplexity-json v1.0")
    )
    return files.withColumn("format_version", F.coalesce(version, F.lit("unknown")))


# Readers of whole files by source; add an entry to support another export.
FILE_READERS: dict[str, Callable[..., DataFrame]] = {
    "claude": read_claude_json,
    "chatgpt": read_chatgpt_tree,
    "gemini": read_gemini,
    "perplexity": read_perplexity,
}


def read_exports(files: DataFrame, readers: dict[str, Callable[..., DataFrame]] | None = None, on_error: str = "raise") -> DataFrame:
    """Messages of mixed files: classify, then run every source's reader on its own files.

    A malformed record raises; with ``on_error="skip"`` it has no messages, see ``silent_files``.
    """
    kinds = classify_exports(files)
    kind = suffix(F.col("path"))
    table = FILE_READERS if readers is None else readers
    parts = []
    for source, reader in table.items():
        mine = F.col("source") == source
        if source == "claude":
            lines = files_where(kinds, mine & (kind == ".jsonl"))
            lines = lines.select("path", F.explode(F.split("content", "\n")).alias("line"))
            parts += [read_claude_markdown(files_where(kinds, mine & (kind == ".md"))), read_claude_jsonl(lines, on_error)]
            mine = mine & (kind == ".json")
        parts.append(reader(files_where(kinds, mine), on_error=on_error))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def silent_files(files: DataFrame, messages: DataFrame) -> DataFrame:
    """(path, error) of files that gave no message at all."""
    heard = messages.select(F.col("path").alias("_path")).distinct()
    silent = files.select("path").join(heard, F.col("path").eqNullSafe(F.col("_path")), "left_anti")
    return silent.select("path", F.lit("No messages found in conversation").alias("error"))
