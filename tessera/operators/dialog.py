"""Dialogs: what is asked, streamed answers, and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import strip


def dialog_text(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """by, n, only (the single message's text) and dialog (lines of user and assistant in order, each stripped; a null text is empty)."""
    said = F.coalesce(strip(F.col("text")), F.lit(""))
    line = F.when(F.col("role") == "user", F.concat(F.lit("User: "), said)).when(F.col("role") == "assistant", F.concat(F.lit("Assistant: "), said))
    lines = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line"), "text"))), lambda x: x["line"]), lambda x: x.isNotNull())
    return messages.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("only"), F.array_join(lines, "\n").alias("dialog"))


def intent(messages: DataFrame, answer=lambda dialog: dialog, by: str = "conv_id") -> DataFrame:
    """by, intent: a single message as it stands, else a model's answer to the dialog (`answer` builds the column and sees no single message)."""
    d = dialog_text(messages, by)
    alone = d.filter("n = 1").select(by, F.coalesce(strip(F.col("only")), F.lit("")).alias("intent"))
    return alone.unionByName(d.filter("n > 1").select(by, "dialog").select(by, strip(answer(F.col("dialog"))).alias("intent")))


def stream_text(frames: DataFrame, by: str = "stream", order: str = "seq", line: str = "line") -> DataFrame:
    """by, answer: the pieces of server-sent frames up to the end mark; other lines, bad JSON and empty pieces are left out."""
    data = F.when(F.startswith(F.col(line), F.lit("data: ")), F.substring(line, 7, 1 << 30))
    ends = F.sum(F.when(strip(F.col("__d")) == "[DONE]", 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order))
    piece = F.get_json_object("__d", "$.choices[0].delta.content")
    used = frames.withColumn("__d", data).withColumn("__e", ends).withColumn("__p", F.when((F.col("__e") == 0) & F.col("__d").isNotNull(), piece))
    return used.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__p") != "", F.struct(order, "__p")))), lambda x: x["__p"]), "").alias("answer"))


def status_event(text: Column, done: Column) -> Column:
    return F.to_json(F.struct(F.struct(F.lit("status").alias("type"), F.struct(text.alias("description"), done.alias("done")).alias("data")).alias("event")))


def citation_event(name: Column, text: Column, path: Column) -> Column:
    data = F.struct(F.array(text).alias("document"), F.array(F.struct(path.alias("source"))).alias("metadata"), F.struct(name.alias("name")).alias("source"))
    return F.to_json(F.struct(F.struct(F.lit("citation").alias("type"), data.alias("data")).alias("event")))
