"""Questions and conversations: histories, requests to expand, and what a model is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import SPACE, trim

#: Fixed value: a message that only asks for the full answer.
EXPAND = rf"(?iu)^(?:да|покажи|показать|подробнее|разверни|открой|выведи)(?:{SPACE}+(?:полный|подробный))?(?:{SPACE}+ответ|{SPACE}+текст)?[.!?]*$"
NOTHING = "Фрагменты документов не найдены. Возможно, документы ещё не загружены или не проиндексированы (OCR)."
BETWEEN = "\n\n---\n\n"
KEPT_TURNS, KEPT_CHARS, KEPT_CHAT = 8, 4000, 40

#: Characters for a document, documents, and whether contexts are wide, by mode.
BUDGETS = {"preview": (4_000, 2, False), "full": (100_000, 2, True)}


def asks_to_expand(c: Column) -> Column:
    return F.coalesce(trim(c).rlike(EXPAND), F.lit(False))


def last(messages: DataFrame, count: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``count`` rows of each key. Rows of equal order are kept by their content."""
    rest = [F.desc(c) for c in messages.columns if c not in (key, order)]
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), *rest))
    return messages.withColumn("rank", rank).filter(F.col("rank") <= count).drop("rank")


def history(messages: DataFrame, turns: int = KEPT_TURNS) -> DataFrame:
    """(conv_id, turn, role, content): what of a conversation is sent on: the last messages by
    user or assistant that aren't blank, cut to 4000 characters. Nulls drop out."""
    own = messages.select("conv_id", "turn", "role", trim(F.col("content")).alias("content"))
    own = own.filter(F.col("role").isin("user", "assistant") & (F.length("content") > 0))
    return last(own.withColumn("content", F.substring("content", 1, KEPT_CHARS)), turns)


def pending(messages: DataFrame) -> DataFrame:
    """Each conversation up to its last message marked ``pending``; others have no rows."""
    upto = messages.filter("pending").groupBy("conv_id").agg(F.max("turn").alias("upto"))
    # one row for each conversation; how it is joined is left to its size
    upto = upto.withColumnRenamed("conv_id", "of")
    return messages.join(upto, F.equal_null("conv_id", "of")).filter(F.col("turn") <= F.col("upto")).drop("upto", "of")


def sessions(events: DataFrame) -> DataFrame:
    """(chat, slug, scope_path, mode, pending, since): each chat's session after its events (chat,
    at, event_id, kind, value).

    'direction' chooses a direction and empties scope, question and mode; 'folder' sets the
    scope and empties the question; 'mode' is what the next message is for; 'question' is kept
    as pending until it is answered ('answered'). Each part is the last event that sets it, a
    partial aggregate, so a chat of any length is no hot spot.
    """
    at = F.struct("at", "event_id")
    last = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.struct(at.alias("t"), "kind", "value")))
    own = events.groupBy("chat").agg(last("direction").alias("d"), last("direction", "folder").alias("f"), last("direction", "mode").alias("m"), last("direction", "folder", "question", "answered").alias("q"), last("direction", "folder", "question", "answered").getField("t").getField("at").alias("since"))
    value = lambda c, kind, none: F.coalesce(F.when(F.col(c)["kind"] == kind, F.col(c)["value"]), F.lit(none))
    return own.select("chat", F.coalesce("d.value", F.lit("")).alias("slug"), value("f", "folder", "").alias("scope_path"), value("m", "mode", "none").alias("mode"), F.when(F.col("q.kind") == "question", F.col("q.value")).alias("pending"), "since")


def routed(messages: DataFrame) -> DataFrame:
    """Messages with what is done about each: by the session's mode, its pending question
    and its direction (columns mode, has_pending, slug)."""
    text = trim(F.col("content"))
    action = (
        F.when(text.startswith("/"), "command")
        .when(F.col("mode") == "search", "search")
        .when(F.col("mode") == "question", "ask")
        .when(asks_to_expand(text) & F.col("has_pending"), "expand")
        .when(F.col("slug").isNotNull() & (F.length(text) >= 3), "ask")
        .otherwise("ignore")
    )
    return messages.withColumn("action", action)


def block(rank: Column, name: Column, path: Column, text: Column, extractor: Column, confidence: Column) -> Column:
    """A document's part of what a model is given."""
    note = F.when(extractor.isNotNull(), F.concat(F.lit(" [extractor="), extractor, F.lit(", confidence="), F.format_string("%.2f", F.coalesce(confidence, F.lit(0.0))), F.lit("]"))).otherwise("")
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), name, F.lit(" ("), path, F.lit(")"), note, F.lit("\n"), text)


def context_text(items: DataFrame) -> DataFrame:
    """(context): the documents' parts in order, or a note that there are none."""
    part = F.struct("rank", block(*(F.col(c) for c in ("rank", "name", "path", "text", "extractor", "confidence"))).alias("b"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["b"]), BETWEEN)
    return items.agg(F.when(F.count("*") == 0, F.lit(NOTHING)).otherwise(joined).alias("context"))


def messages(context: DataFrame, system: str, question: str, past: DataFrame | None = None, attachment: str = "") -> DataFrame:
    """(messages): system prompt, at most eight earlier messages, and the question with its
    attachment and context, for a model."""
    whole = "\n\n".join(x for x in (question.strip(), attachment.strip()) if x)
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    ask = F.concat(F.lit(whole), F.lit(BETWEEN), F.col("context"))
    if past is None:
        return context.select(F.array(one("system", F.lit(system)), one("user", ask)).alias("messages"))
    turns = history(past).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("t"))
    earlier = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    both = context.withColumn("one", F.lit(1)).join(turns.withColumn("one", F.lit(1)), "one")
    return both.select(F.concat(F.array(one("system", F.lit(system))), earlier, F.array(one("user", ask))).alias("messages"))


def answered(prompts: DataFrame, model: Callable[[list], str]) -> DataFrame:
    """(answer, error) of each prompt by a callable; a failure is a value, not an end."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            answers, errors = [], []
            for prompt in batch.column(0).to_pylist():
                try:
                    answers.append(model(prompt))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["answer", "error"])

    return prompts.select("messages").mapInArrow(run, "answer string, error string")
