"""Rule extraction from messages to context items.

A context is kept as a long table, one row per extracted item:

    conv_id, section, ord, label, text, detail, priority, done

``section`` is goal, tech_stack, decision, task, constraint, non_goal or open_question. ``label`` is
the category of a technology or the topic of a decision, ``detail`` the rationale of a decision or
the description of a task. ``ord`` sorts the items of a section. A context of any size is then just
rows; only the renderers bring rows together again.

All sections come out of one scan of the messages and one shuffle on (conversation, section, item).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.automaton import contained_terms
from threadloom.functions.ordering import ord_of, top_rows
from threadloom.lexicons import (
    DEFAULT_LEXICON,
    DOMAIN_RULES,
    LIST_ITEM,
    MUST_SUBJECT,
    OPEN_POINT,
    QUESTION,
    SESSION_DECISION,
    DomainRule,
    Lexicon,
)
from threadloom.operators.messages import question_quality

SECTIONS = ("goal", "tech_stack", "decision", "task", "constraint", "non_goal", "open_question")
ITEM_COLUMNS = ["section", "ord", "label", "text", "detail", "priority", "done"]


def split_sentences(messages: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """(keys, msg_seq, sent_ord, sentence)."""
    return messages.select(
        *keys, F.col("seq").alias("msg_seq"), F.posexplode(T.sentences(F.col("content"))).alias("sent_ord", "sentence")
    )


def match_lexicon(
    sentences: DataFrame, lexicon: dict[str, Sequence[str]], keys: Sequence[str] = ("conv_id",)
) -> DataFrame:
    """Every (sentence, keyword) hit, with the category and the list position of the keyword.

    The lexicon is part of the plan, so matching needs neither a join nor a shuffle.
    """
    low = F.col("_low")
    tests = [
        F.when(low.contains(word), F.struct(F.lit(category).alias("category"), F.lit(i).alias("kw_ord"), F.lit(word).alias("keyword")))
        for category, listed in lexicon.items()
        for i, word in enumerate(listed)
    ]
    return (
        sentences.withColumn("_low", F.lower("sentence")).withColumn("hit", F.explode(F.array(*tests)))
        .filter("hit IS NOT NULL")
        .select(*keys, "msg_seq", "sent_ord", "sentence", "hit.*")
    )


def match_terms(
    sentences: DataFrame, terms: DataFrame, keys: Sequence[str] = ("conv_id",), columns: Sequence[str] = ("category", "kw_ord", "keyword")
) -> DataFrame:
    """The same hits for a lexicon kept as a table ``terms(category, kw_ord, keyword)`` of any length.

    Neither the plan nor the reading of a sentence grows with the number of terms, but every listing of a
    keyword is a hit of its own. Where a keyword is listed many times and hits are only counted or
    compared, gather its listings first, as ``term_ordinals`` does, and name the ``columns`` a hit takes along.
    """
    lowered = sentences.withColumn("_low", F.lower("sentence"))
    return contained_terms(lowered, terms.select(*columns), "_low").select(*keys, "msg_seq", "sent_ord", "sentence", *columns)


def term_ordinals(sentences: DataFrame, terms: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """(keys, msg_seq, sent_ord, category, first_ord, last_ord): the first and the last listed term of each category in a sentence."""
    gathered = terms.groupBy("category", "keyword").agg(F.min("kw_ord").alias("first_ord"), F.max("kw_ord").alias("last_ord"))
    hits = match_terms(sentences, gathered, keys, gathered.columns)
    return hits.groupBy(*keys, "msg_seq", "sent_ord", "category").agg(F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"))


# ---- candidates ----------------------------------------------------------------------------------


def _candidate(section: str, key: Column, first: Column, text: Column, last: Column | None = None, **extra: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        key.alias("key"),
        first.alias("first"),
        (first if last is None else last).alias("last"),
        text.alias("text"),
        extra.get("label", F.lit("")).alias("label"),
        extra.get("priority", F.lit("")).alias("priority"),
    )


def _tech_key(low: Column, tech: dict) -> Column:
    """Technology named in the sentence: of the last category that has one, its first in the list."""
    per_category = [
        F.coalesce(*[F.when(low.contains(word), F.lit(word)) for word in listed]) for listed in tech.values()
    ]
    return F.coalesce(*reversed(per_category), low) if per_category else low


def _sentence_candidates(lexicon: Lexicon, sections: Sequence[str]) -> list[Column]:
    text, low, seq, pos = F.col("text"), F.col("low"), F.col("seq"), F.col("pos")

    def at(kw: Column) -> Column:
        return ord_of(seq=seq, kw=kw, pos=pos)

    out = []
    if "goal" in sections:
        kw = T.first_index(low, lexicon.intents)
        goal = _candidate("goal", F.lit(""), at(kw), T.clean_goal(text, lexicon.goal_prefixes))
        out.append(F.when((F.col("role") == "user") & kw.isNotNull(), goal))
    if "decision" in sections:
        kw = T.first_index(low, lexicon.decisions)
        last = at(T.last_index(low, lexicon.decisions))
        out.append(F.when(kw.isNotNull(), _candidate("decision", _tech_key(low, lexicon.tech), at(kw), text, last)))
    if "constraint" in sections:
        noisy = {
            i: text.rlike(MUST_SUBJECT) for i, w in enumerate(lexicon.constraints) if w == lexicon.needs_subject
        }
        kw = T.first_index(low, lexicon.constraints, noisy)
        out.append(F.when(kw.isNotNull(), _candidate("constraint", T.dedup_key(text), at(kw), text)))
    if "non_goal" in sections:
        kw = T.first_index(low, lexicon.non_goals)
        out.append(F.when(kw.isNotNull(), _candidate("non_goal", T.dedup_key(text), at(kw), text)))
    return out


def _after_header(content: Column, low: Column, headers: Sequence[str]) -> Column:
    """Content after the first occurrence of the first listed header that it holds."""
    cuts = [F.when(low.contains(h), F.substr(content, F.instr(low, h) + len(h))) for h in headers]
    return F.coalesce(*cuts, content)


def _numbered(texts: Column, kind: str, sub: int = 0) -> Column:
    return F.transform(
        texts,
        lambda t, i: F.struct(F.lit(kind).alias("kind"), F.lit(sub).alias("sub"), i.alias("pos"), t.alias("text")),
    )


def _fragments(lexicon: Lexicon, sections: Sequence[str]) -> Column:
    """Array of the pieces of one message (content, and low in lower case) that candidates are made of."""
    content, low = F.col("content"), F.col("low")
    nothing = F.array().cast("array<struct<kind:string,sub:int,pos:int,text:string>>")
    parts = []
    phrases: list[str] = []
    for section, listed in (
        ("goal", lexicon.intents),
        ("decision", lexicon.decisions),
        ("constraint", lexicon.constraints),
        ("non_goal", lexicon.non_goals),
    ):
        if section in sections:
            phrases += listed
    if phrases:  # the cheap test on the whole message saves the sentence split on most of them
        parts.append(F.when(T.contains_any(low, phrases), _numbered(T.sentences(content), "sentence")))
    if "goal" in sections:
        fallback = F.when(F.col("role") == "user", T.clean_goal(content, lexicon.goal_prefixes)).otherwise("")
        parts.append(_numbered(F.array(fallback), "fallback"))
    if "task" in sections:
        listed = F.regexp_extract_all(_after_header(content, low, lexicon.task_headers), F.lit(LIST_ITEM), F.lit(1))
        parts.append(_numbered(F.filter(F.transform(listed, T.strip), lambda t: t != ""), "task"))
    if "open_question" in sections:
        asked = F.transform(F.regexp_extract_all(content, F.lit(QUESTION), F.lit(0)), T.strip)
        parts.append(F.when(content.contains("?"), _numbered(F.filter(asked, question_quality), "question")))
        opened = F.transform(F.regexp_extract_all(content, F.lit(OPEN_POINT), F.lit(0)), T.strip)
        parts.append(_numbered(opened, "question", 1))
    if "tech_stack" in sections and lexicon.tech:
        found = [
            F.when(
                low.contains(word) & low.rlike(rf"(?U)\b\Q{word}\E\b"),
                F.struct(F.lit("tech").alias("kind"), F.lit(c).alias("sub"), F.lit(i).alias("pos"), F.lit(shown).alias("text")),
            )
            for c, listed in enumerate(lexicon.tech.values())
            for i, (word, shown) in enumerate(listed.items())
        ]
        parts.append(F.filter(F.array(*found), lambda f: f.isNotNull()))
    return F.concat(*[F.coalesce(p, nothing) for p in parts])


def _spanning_tech(messages: DataFrame, lexicon: Lexicon, keys: Sequence[str]) -> DataFrame:
    """Technologies of several words that start at the end of one message and finish in the next.

    Messages count as joined by one space, so such a name breaks at one of its own spaces. Only
    messages that end or start with a part of a name leave a row here; ``seq`` must be gapless.
    """
    low = F.col("low")
    halves = []
    for c, listed in enumerate(lexicon.tech.values()):
        for i, (word, shown) in enumerate(listed.items()):
            words = word.split(" ")
            for cut in range(1, len(words)):
                left, right = " ".join(words[:cut]), " ".join(words[cut:])

                def half(side: str, at: Column, c: int = c, i: int = i, cut: int = cut, shown: str = shown) -> Column:
                    fixed = {"side": side, "sub": c, "pos": i, "cut": cut, "text": shown}
                    return F.struct(at.alias("at"), *[F.lit(v).alias(name) for name, v in fixed.items()])

                ends = low.endswith(left) & low.rlike(rf"(?U)\b\Q{left}\E\z")
                starts = low.startswith(right) & low.rlike(rf"(?U)\A\Q{right}\E\b")
                halves += [F.when(ends, half("left", F.col("seq") + 1)), F.when(starts, half("right", F.col("seq") + 0))]
    rows = (
        messages.withColumn("low", F.lower("content")).select(*keys, F.explode(F.array(*halves)).alias("h")).filter("h IS NOT NULL").select(*keys, "h.*")
    )
    return (
        rows.groupBy(*keys, "at", "sub", "pos", "cut", "text")
        .agg(F.count_distinct("side").alias("sides"))
        .filter("sides = 2")
        .select(*keys, F.col("at").alias("seq"), F.lit("").alias("role"), F.lit("tech").alias("kind"), F.col("sub").cast("int").alias("sub"), F.col("pos").cast("int").alias("pos"), "text")
    )


def item_candidates(
    messages: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    sections: Sequence[str] = SECTIONS,
    keys: Sequence[str] = ("conv_id",),
) -> DataFrame:
    """Candidate items of every message: (keys, section, key, first, last, text, label, priority)."""
    # lower case is a column of its own: dozens of tests look at it, and each would compute it anew
    lowered = messages.withColumn("low", F.lower("content"))
    pieces = lowered.select(
        *keys, F.col("seq").cast("bigint").alias("seq"), "role", F.explode(_fragments(lexicon, sections)).alias("f")
    ).select(*keys, "seq", "role", "f.kind", "f.sub", "f.pos", "f.text")
    if "tech_stack" in sections and any(" " in w for listed in lexicon.tech.values() for w in listed):
        pieces = pieces.unionByName(_spanning_tech(messages, lexicon, keys))
    pieces = pieces.withColumn("low", F.when(F.col("kind") == "sentence", F.lower("text")))
    kind, text = F.col("kind"), F.col("text")
    here = ord_of(seq=F.col("seq"), sub=F.col("sub"), pos=F.col("pos"))
    options = [F.when(kind == "sentence", c) for c in _sentence_candidates(lexicon, sections)]
    if "goal" in sections:  # after every hit; a conversation without user turns keeps an empty goal
        rank = ord_of(src=F.when(F.col("role") == "user", 1).otherwise(2), seq=F.col("seq"))
        options.append(F.when(kind == "fallback", _candidate("goal", F.lit(""), rank, text)))
    if "task" in sections:
        urgent = text.contains("!") | F.lower(text).contains("high priority")
        priority = F.when(urgent, "high").otherwise("medium")
        options.append(F.when(kind == "task", _candidate("task", F.lower(text), here, text, priority=priority)))
    if "open_question" in sections:
        options.append(F.when(kind == "question", _candidate("open_question", T.dedup_key(text), here, text)))
    if "tech_stack" in sections and lexicon.tech:
        category = F.element_at(F.array(*[F.lit(c) for c in lexicon.tech]), F.col("sub") + 1)
        by_list = ord_of(seq=F.col("sub"))
        last = ord_of(kw=F.col("pos"))
        options.append(F.when(kind == "tech", _candidate("tech_stack", category, by_list, text, last, label=category)))
    return (
        pieces.select(*keys, F.explode(F.array(*options)).alias("c"))
        .filter("c IS NOT NULL")
        .select(*keys, "c.*")
        .filter(~F.col("section").isin("constraint", "non_goal", "open_question") | (F.col("key") != ""))
    )


def settle_candidates(candidates: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """One item per key: position of the first candidate; text of the first, or of the last for
    decisions and technologies."""
    takes_last = F.col("section").isin("decision", "tech_stack")
    return (
        candidates.groupBy(*keys, "section", "key")
        .agg(
            F.min("first").alias("ord"),
            F.min_by(F.struct("text", "priority", "label"), F.col("first")).alias("head"),
            F.max_by("text", "last").alias("tail"),
        )
        .select(
            *keys,
            "section",
            "ord",
            F.col("head.label").alias("label"),
            F.when(takes_last, F.col("tail")).otherwise(F.col("head.text")).alias("text"),
            F.lit("").alias("detail"),
            F.col("head.priority").alias("priority"),
            F.lit(False).alias("done"),
        )
    )


def extract_items(
    messages: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    sections: Sequence[str] = SECTIONS,
    keys: Sequence[str] = ("conv_id",),
) -> DataFrame:
    """Context items of every conversation, by rule."""
    return settle_candidates(item_candidates(messages, lexicon, sections, keys), keys)


def extract_goal(messages: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    return extract_items(messages, lexicon, ["goal"], keys).select(*keys, F.col("text").alias("goal"))


def extract_decisions(messages: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    items = extract_items(messages, lexicon, ["decision"], keys)
    return items.select(*keys, "ord", F.col("label").alias("topic"), F.col("text").alias("decision"), F.col("detail").alias("rationale"))


def extract_constraints(messages: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    return extract_items(messages, lexicon, ["constraint"], keys).select(*keys, "ord", "text")


def extract_non_goals(messages: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    return extract_items(messages, lexicon, ["non_goal"], keys).select(*keys, "ord", "text")


def extract_tasks(messages: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    items = extract_items(messages, lexicon, ["task"], keys)
    return items.select(*keys, "ord", F.col("text").alias("title"), F.col("detail").alias("description"), "priority", "done")


def extract_open_questions(messages: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    return extract_items(messages, lexicon, ["open_question"], keys).select(*keys, "ord", "text")


def canonical_tech(word: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Display name of a technology by its lower-case keyword; null where the word list does not know it."""
    names = {keyword: name for listed in lexicon.tech.values() for keyword, name in listed.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), word)


def extract_tech_stack(messages: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """(keys, tech_stack map): at most one entry per category of the lexicon."""
    items = extract_items(messages, lexicon, ["tech_stack"], keys)
    entries = F.array_sort(F.collect_list(F.struct(F.col("ord.seq").alias("o"), "label", "text")))
    pairs = F.transform("entries", lambda e: F.struct(e["label"], e["text"]))
    return items.groupBy(*keys).agg(entries.alias("entries")).select(*keys, F.map_from_entries(pairs).alias("tech_stack"))


def extract_context(
    messages: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    extracted_at: str | None = None,
    keys: Sequence[str] = ("conv_id",),
) -> DataFrame:
    """All items plus the run's fields; ``extracted_at`` is a parameter so that results repeat."""
    at = F.lit(extracted_at) if extracted_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return extract_items(messages, lexicon, SECTIONS, keys).select(
        *keys, F.lit("1.0").alias("schema_version"), at.alias("extracted_at"), *ITEM_COLUMNS
    )


def extraction_summary(messages: DataFrame, items: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Counts of messages, decisions, tasks, constraints and questions per key."""
    names = {"message": "messages", "decision": "decisions", "task": "tasks", "constraint": "constraints", "open_question": "open_questions"}
    kinds = messages.select(*keys, F.lit("message").alias("section")).unionByName(items.select(*keys, "section"))
    counts = [F.count_if(F.col("section") == s).alias(n) for s, n in names.items()]
    return kinds.groupBy(*keys).agg(*counts)


def detect_domains(
    messages: DataFrame,
    items: DataFrame,
    rules: Sequence[DomainRule] = DOMAIN_RULES,
    keys: Sequence[str] = ("conv_id",),
) -> DataFrame:
    """(keys, domain, rule_ord, skills): rules with any keyword in the conversation or its items.

    The reference text is never put together: a substring of the whole is a substring of one part,
    as long as keywords hold no line break.
    """
    corpus = messages.select(*keys, F.lower("content").alias("body"))
    sources = items.filter(F.col("section").isin("tech_stack", "decision", "task"))
    fields = F.when(F.col("section") == "decision", F.array("label", "text")).otherwise(F.array("text", "detail"))
    bodies = corpus.unionByName(sources.select(*keys, F.explode(F.transform(fields, F.lower)).alias("body")))
    seen_skills: set[str] = set()
    hits = []
    for i, rule in enumerate(rules):
        fresh = [s for s in rule.skills if s not in seen_skills]
        seen_skills.update(fresh)
        skills = F.array(*[F.lit(s) for s in fresh]).cast("array<string>")
        row = F.struct(F.lit(rule.name).alias("domain"), F.lit(i).alias("rule_ord"), skills.alias("skills"))
        hits.append(F.when(T.contains_any(F.col("body"), [k.lower() for k in rule.keywords]), row))
    found = bodies.select(*keys, F.explode(F.array(*hits)).alias("hit")).filter("hit IS NOT NULL")
    first = found.select(*keys, "hit.*").groupBy(*keys, "domain").agg(F.min("rule_ord").alias("rule_ord"), F.min_by("skills", "rule_ord").alias("skills"))
    return first


def session_decisions(
    texts: DataFrame, keys: Sequence[str] = ("session_id",), at_least: int = 35, limit: int = 10
) -> DataFrame:
    """First distinct decision sentences in assistant texts (keys, seq, text) of every session."""
    found = F.transform(F.regexp_extract_all("text", F.lit(SESSION_DECISION), F.lit(0)), lambda d: F.rtrim(T.strip(d), F.lit(".,;")))
    rows = texts.select(*keys, "seq", F.posexplode(found).alias("pos", "decision")).filter(F.length("decision") >= at_least)
    distinct = rows.groupBy(*keys, "decision").agg(F.min(F.struct("seq", "pos")).alias("at"))
    return top_rows(distinct, keys, [F.col("at")], limit, name="ord").select(*keys, "ord", "decision")
