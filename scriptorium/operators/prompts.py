"""Contexts, prompts, request payloads and parsed answers, for batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.constants import (
    ANSWER_ERROR,
    ANSWER_HTTP_ERROR,
    CHAT_MODEL,
    DISTANCE_CUTOFF,
    MAX_TOKENS,
    NOTHING_FOUND,
    NOTHING_RELEVANT,
    PROMPT_INSTRUCTIONS,
    PROMPT_QUESTION,
    PROMPT_ROLE,
    PROMPT_RULES,
    SOURCE_UNKNOWN,
    TEMPERATURE,
)
from scriptorium.operators.retrieval import with_chunks


def context_assembly(
    questions: DataFrame, results: DataFrame, chunks: DataFrame, cutoff: float = DISTANCE_CUTOFF
) -> DataFrame:
    """``(query_id, question, context)``: the near fragments of each question as one text.

    ``results`` is ``(query_id, rank, id, distance)``, ``chunks`` is ``(id, source, chunk)``. A group holds
    the top results of one question, so its size is k. The number shown is the rank before the cut-off.
    """
    found = with_chunks(results, chunks)
    part = F.concat(
        F.lit("[Fragmento "),
        "rank",
        F.lit(" - Fuente: "),
        F.coalesce("source", F.lit(SOURCE_UNKNOWN)),
        F.lit("]\n"),
        "chunk",
    )
    near = F.when(F.col("distance") < cutoff, F.struct("rank", part.alias("part")))
    gathered = found.groupBy("query_id").agg(F.sort_array(F.collect_list(near)).alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda item: item["part"]), "\n\n")
    return questions.join(gathered, "query_id", "left").select(
        "query_id",
        "question",
        F.when(F.col("_parts").isNull(), NOTHING_FOUND)
        .when(F.size("_parts") == 0, NOTHING_RELEVANT)
        .otherwise(text)
        .alias("context"),
    )


def prompt_build(contexts: DataFrame, domain: str) -> DataFrame:
    """``(query_id, prompt)``; ``domain`` names the field the assistant is an expert in."""
    return contexts.select(
        "query_id",
        F.concat(
            F.lit(PROMPT_ROLE + domain + PROMPT_RULES),
            "context",
            F.lit(PROMPT_QUESTION),
            "question",
            F.lit(PROMPT_INSTRUCTIONS),
        ).alias("prompt"),
    )


def request_payload(
    prompts: DataFrame, model: str = CHAT_MODEL, max_tokens: int = MAX_TOKENS, temperature: float = TEMPERATURE
) -> DataFrame:
    """``(query_id, payload)``: the JSON body of one chat request per prompt."""
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(message).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(temperature).alias("temperature"),
    )
    return prompts.select("query_id", F.to_json(body).alias("payload"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """``(query_id, answer)`` from ``(query_id, status, reason, body)``; unreadable bodies give the error text."""
    content = F.get_json_object("body", "$.choices[0].message.content")
    return responses.select(
        "query_id",
        F.when(F.col("status") != 200, F.concat(F.lit(ANSWER_HTTP_ERROR), F.coalesce("reason", F.lit(""))))
        .otherwise(F.coalesce(content, F.lit(ANSWER_ERROR)))
        .alias("answer"),
    )
