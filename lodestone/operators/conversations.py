"""Conversations and their messages.

A conversation can be long, so nothing gathers all its messages: exports are lines in order,
nested forms come in segments of bounded length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.functions import text as tx
from lodestone.operators.containing import by_scope, containing
from lodestone.operators.sequences import carry_last

# How many conversations a listing and a local store hold.
RECENT_LIMIT = 50


def auto_titles(messages: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(conversation_id, title): the first user message, unless a real title was given."""
    first = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "turn").alias("_first"))
    auto = tx.clip(F.col("_first"), 40)
    if given is None:
        return first.select("conversation_id", auto.alias("title"))
    empty = F.col("title").isNull() | F.col("title").isin("", "New Chat")
    return given.join(first, "conversation_id", "left").select(
        "conversation_id", F.when(empty & F.col("_first").isNotNull(), auto).otherwise(F.col("title")).alias("title")
    )


def summaries(messages: DataFrame, titles: DataFrame) -> DataFrame:
    """One row per conversation with its times and number of messages."""
    ages = messages.groupBy("conversation_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("messages")
    )
    return ages.join(titles, "conversation_id", "left")


def search(conversations: DataFrame, messages: DataFrame, term: str) -> DataFrame:
    """Conversations whose title or any message contains the term."""
    q = term.strip().lower()
    hits = messages.where(F.lower("content").contains(q)).select("conversation_id").distinct().withColumn("_hit", F.lit(True))
    title = F.when(F.coalesce("title", F.lit("")) == "", "New Chat").otherwise(F.col("title"))
    return (
        conversations.join(hits, "conversation_id", "left")
        .where(F.lower(title).contains(q) | F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def hits(requests: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """`search` for a table (request_id, user_id, workspace_id, term): pairs (request_id, conversation_id).

    A request sees its user's conversations, of the given workspace or of all. Blanks around a term do not count.
    """
    title = F.when(F.coalesce("title", F.lit("")) == "", "New Chat").otherwise(F.col("title"))
    heads = conversations.select("conversation_id", "user_id", F.lit(-1).cast("bigint").alias("turn"), title.alias("_said"))
    owners = conversations.select("conversation_id", "user_id")
    said = messages.select("conversation_id", F.col("turn").cast("bigint").alias("turn"), F.col("content").alias("_said"))
    texts = heads.unionByName(said.join(owners, "conversation_id").select(heads.columns))
    asked = requests.select("request_id", "user_id", F.col("workspace_id").alias("_ws"), F.lower(tx.strip(F.col("term"))).alias("term"))
    found = containing(asked, texts, ["conversation_id", "turn"], ["user_id"], "_said")
    found = found.select("user_id", "term", "conversation_id").distinct()
    found = found.join(conversations.select("conversation_id", "workspace_id"), "conversation_id")
    pairs = asked.join(found, ["user_id", "term"])
    return pairs.where("_ws IS NULL OR _ws = workspace_id").select("request_id", "conversation_id")


def markdown_lines(messages: DataFrame, titles: DataFrame) -> DataFrame:
    """Markdown export as lines (conversation_id, turn, part, line); order by these columns.

    `citations`, where present, is an array of (document_name, page_number) on each message.
    """
    title = F.when(F.coalesce("title", F.lit("")) == "", "Chat export").otherwise(F.col("title"))
    none = F.lit(-1).cast("bigint")
    heads = titles.select(
        "conversation_id", none.alias("turn"), F.lit(0).alias("part"), F.concat(F.lit("# "), title).alias("line")
    )
    head = F.when(F.col("role") == "user", "## User").otherwise("## Assistant")
    parts = F.array(head, tx.strip(F.col("content")))
    if "citations" in messages.columns:
        names = F.transform(
            "citations",
            lambda c, i: F.concat(
                F.lit("- ["), i + 1, F.lit("] "), c["document_name"],
                F.when(c["page_number"].isNotNull(), F.concat(F.lit(", p."), c["page_number"])).otherwise(""),
            ),
        )
        sources = F.when(
            (F.col("role") == "assistant") & (F.size("citations") > 0), F.concat(F.array(F.lit("**Sources:**")), names)
        ).otherwise(F.array().cast("array<string>"))
        parts = F.concat(parts, sources)
    body = messages.select("conversation_id", "turn", F.posexplode(parts).alias("part", "line"))
    return heads.unionByName(body)


def transcript(messages: DataFrame) -> DataFrame:
    """Lines `Role: text` (conversation_id, turn, line); blank messages are left out."""
    text = tx.strip(F.col("content"))
    role = F.initcap(F.coalesce("role", F.lit("user")))
    return messages.where(text != "").select("conversation_id", "turn", F.concat(role, F.lit(": "), text).alias("line"))


def nested(messages: DataFrame, segment: int = 500) -> DataFrame:
    """Messages nested in order: (conversation_id, segment, messages), at most `segment` turns each."""
    part = F.floor(F.col("turn") / segment).alias("segment")
    item = F.struct("turn", "role", "content")
    return messages.groupBy("conversation_id", part).agg(F.sort_array(F.collect_list(item)).alias("messages"))


def parse_json_array(c: str, element: str):
    """Array stored as JSON text; broken text is an empty array, missing text stays missing."""
    empty = F.array().cast(f"array<{element}>")
    return F.when(F.col(c).isNotNull(), F.coalesce(F.from_json(c, f"array<{element}>"), empty))


def pinned_split(messages: DataFrame, pinned: DataFrame) -> DataFrame:
    """Mark messages as pinned assistant messages or the rest; pinned user messages are in neither."""
    marks = pinned.select("conversation_id", "turn", F.lit(True).alias("_p")).distinct()
    df = messages.join(marks, ["conversation_id", "turn"], "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    df = df.where(~F.col("_p") | (F.col("role") == "assistant"))
    return df.withColumn("bucket", F.when(F.col("_p"), "pinned").otherwise("rest")).drop("_p")


def turn_pairs(messages: DataFrame) -> DataFrame:
    """Assistant turns with the last user turn before them."""
    df = carry_last(messages, "conversation_id", "turn", F.col("role") == "user", "content", "question")
    return df.where("role = 'assistant'")


def recent(conversations: DataFrame, user_id: str, workspace_id: str | None = None, limit: int = RECENT_LIMIT) -> DataFrame:
    """A user's most recently updated conversations."""
    df = conversations.where(F.col("user_id") == user_id)
    if workspace_id:
        df = df.where(F.col("workspace_id") == workspace_id)
    return df.orderBy(F.desc("updated_at"), "conversation_id").limit(limit)


def recent_in(scopes: DataFrame, conversations: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """`recent` for every different (user_id, workspace_id), either of them null for all, with the place in the listing."""
    rows = by_scope(scopes, conversations, ["user_id", "workspace_id"])
    order = W.partitionBy("scope_user_id", "scope_workspace_id").orderBy(F.desc("updated_at"), "conversation_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def pinned_first(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(*_pinned_order())


def pinned_places(conversations: DataFrame) -> DataFrame:
    """The same order as a place within the workspace."""
    return conversations.withColumn("place", F.row_number().over(W.partitionBy("workspace_id").orderBy(*_pinned_order())))


def _pinned_order() -> list:
    return [F.desc(F.coalesce("is_pinned", F.lit(False))), F.desc("updated_at"), F.col("conversation_id")]


def recent_per_workspace(conversations: DataFrame, n: int = 5) -> DataFrame:
    order = W.partitionBy("workspace_id").orderBy(F.desc("updated_at"), "conversation_id")
    return conversations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def merge_remote(remote: DataFrame, local: DataFrame, limit: int | None = None) -> DataFrame:
    """Remote conversations first, then local ones unknown there."""
    extra = local.join(remote.select("conversation_id"), "conversation_id", "left_anti")
    both = remote.withColumn("source", F.lit("remote")).unionByName(extra.select(remote.columns).withColumn("source", F.lit("local")))
    if limit is None:
        return both
    return both.orderBy(F.desc("source"), F.desc("updated_at"), "conversation_id").limit(limit)


def reply_threads(messages: DataFrame) -> DataFrame:
    """Messages with the one they reply to (parent_turn), one level."""
    parents = messages.select("conversation_id", F.col("turn").alias("parent_turn"), F.col("role").alias("parent_role"), F.col("content").alias("parent_content"))
    return messages.join(parents, ["conversation_id", "parent_turn"], "left")
