"""Short-term conversation memory: recent turns whole, older ones in brief."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

TURNS, SNIPPET, SUMMARY, QUERY = 8, 300, 2000, 4000


def folded(conversations: DataFrame, max_turns: int = TURNS) -> DataFrame:
    """(conv_id, summary, recent) of whole conversations (conv_id, turn, role, text).

    Turns beyond the last `max_turns` shrink to a line each; of those lines the
    last 2000 characters stay.  One shuffle by conversation.
    """
    said = conversations.select("conv_id", "turn", "role", T.strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    all_turns = said.groupBy("conv_id").agg(turns.alias("turns"))
    old = F.slice("turns", F.lit(1), F.greatest(F.size("turns") - max_turns, F.lit(0)))

    def add(have: Column, t: Column) -> Column:
        line = F.concat(t["role"], F.lit(": "), F.substring(t["text"], 1, SNIPPET))
        both = T.strip(F.concat(have, F.lit("\n"), line))
        return F.when(F.length(both) > SUMMARY, F.substring(both, -SUMMARY, SUMMARY)).otherwise(both)

    recent = F.slice("turns", F.greatest(F.size("turns") - max_turns, F.lit(0)) + 1, F.lit(max_turns))
    return all_turns.select("conv_id", F.aggregate(old, F.lit(""), add).alias("summary"), recent.alias("recent"))


def context_query(memory: DataFrame, query: Column) -> DataFrame:
    """(conv_id, context_query): summary, the user's recent turns and the query."""
    own = F.array_join(F.transform(F.filter("recent", lambda t: t["role"] == "user"), lambda t: t["text"]), " ")
    parts = F.filter(F.array("summary", own, query), lambda p: F.coalesce(p, F.lit("")) != "")
    full = F.array_join(parts, "\n")
    return memory.select("conv_id", F.when(F.length(full) > QUERY, F.substring(full, -QUERY, QUERY)).otherwise(full).alias("context_query"))


def as_text(memory: DataFrame) -> DataFrame:
    turns = F.transform("recent", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    head = F.when(F.col("summary") != "", F.array(F.concat(F.lit("[earlier conversation summary]\n"), "summary"))).otherwise(F.array().cast("array<string>"))
    return memory.select("conv_id", F.array_join(F.concat(head, turns), "\n").alias("text"))


class ConversationMemory:
    """The same for one running conversation, on the driver."""

    def __init__(self, max_turns: int = TURNS, summarize: Callable[[str], str] | None = None) -> None:
        self.max_turns, self.summarize = max_turns, summarize
        self.clear()

    def clear(self) -> None:
        self.turns: deque[tuple[str, str]] = deque()
        self.summary = ""

    def add(self, role: str, text: str | None) -> None:
        if text := (text or "").strip():
            self.turns.append((role, text))
        while len(self.turns) > self.max_turns:
            old_role, old = self.turns.popleft()
            both = f"{self.summary}\n{old_role}: {old[:SNIPPET]}".strip()
            if self.summarize and len(both) > 1500:
                try:
                    both = self.summarize(both)
                except Exception:
                    both = both[-1500:]
            self.summary = both[-SUMMARY:]

    def add_user(self, text: str) -> None:
        self.add("user", text)

    def add_assistant(self, text: str) -> None:
        self.add("assistant", text)

    def context_query(self, query: str) -> str:
        own = " ".join(t for r, t in self.turns if r == "user")
        return "\n".join(p for p in (self.summary, own, query) if p)[-QUERY:]

    def as_text(self) -> str:
        head = [f"[earlier conversation summary]\n{self.summary}"] if self.summary else []
        return "\n".join(head + [f"{r}: {t}" for r, t in self.turns])
