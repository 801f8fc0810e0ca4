"""The conversation log: two append-only tables, from which lists and threads are derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONVERSATION = "id bigint, title string, author_key string, mode string, created_at timestamp"
MESSAGE = "id bigint, conversation_id bigint, role string, content string, sources_json string, created_at timestamp"
#: Characters of a title that are kept. Fixed value.
TITLE_CHARS = 80
SOURCES = "array<struct<index:int,work_title:string,section_title:string,source_ref:string,snippet:string,distance:double>>"


def new_conversations(rows: DataFrame) -> DataFrame:
    """rows (id, title, author_key, mode, created_at) as they are stored."""
    return rows.select("id", F.substring("title", 1, TITLE_CHARS).alias("title"), "author_key", "mode", "created_at")


def new_messages(rows: DataFrame, sources: Column | None = None) -> DataFrame:
    """rows (id, conversation_id, role, content, created_at) as they are stored, with their sources as JSON."""
    return rows.select("id", "conversation_id", "role", "content", F.coalesce(F.to_json(sources) if sources is not None else F.lit(None), F.lit("[]")).alias("sources_json"), "created_at")


def list_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with updated_at, the time of the last message (or of creation); latest first."""
    last = messages.groupBy("conversation_id").agg(F.max("created_at").alias("last"))
    out = conversations.join(last, conversations["id"] == last["conversation_id"], "left")
    return out.select("id", "title", "author_key", "mode", "created_at", F.coalesce(F.greatest("created_at", "last"), "created_at").alias("updated_at")).orderBy(F.desc("updated_at"), F.desc("id"))


def thread(messages: DataFrame, conversation_id: int) -> DataFrame:
    """(role, content, sources) of a conversation in order."""
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("id").select("role", "content", F.from_json(F.coalesce(F.nullif("sources_json", F.lit("")), F.lit("[]")), SOURCES).alias("sources"))


def without(conversations: DataFrame, messages: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in deleted (id) and their messages."""
    gone = deleted.select(F.col("id").alias("gone"))
    return conversations.join(gone, F.col("id") == F.col("gone"), "left_anti"), messages.join(gone, F.col("conversation_id") == F.col("gone"), "left_anti")
