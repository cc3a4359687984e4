"""The seam to a model: any callable on prompts, called batch by batch on the executors, and tokenizers as callables.

Replay (``tables.replay``) stands in for a model everywhere; these are for those who have one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def generate(cases: DataFrame, load: Callable[[], Callable[[list[dict]], str]], column: str = "raw_output", prompt: str = "messages", max_prompt: int | None = None, count: Callable[[str], int] | None = None) -> DataFrame:
    """``cases`` with ``column``: what a model answers to each row's chat messages, and ``error``, null where it answered.

    ``load`` runs once for each task and gives the model: a function of a list of messages (role, content). A prompt of more
    than ``max_prompt`` tokens, by ``count``, is refused, and an exception becomes the row's error: no row is lost. Nothing is
    repaired or cut.
    """
    schema = cases.drop(column, "error").schema.add(column, "string").add("error", "string")
    kept = [f.name for f in schema if f.name not in (column, "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            out: list[tuple[str | None, str | None]] = []
            for chat in b[prompt]:
                chat = [m if isinstance(m, dict) else m.asDict() for m in chat]
                try:
                    if max_prompt is not None and sum((count or len)(m["content"]) for m in chat) > max_prompt:
                        raise ValueError(f"prompt over {max_prompt} tokens")
                    out.append((model(chat), None))
                except Exception as error:
                    out.append((None, f"{type(error).__name__}: {error}"))
            yield b[kept].assign(**{column: [x for x, _ in out], "error": [e for _, e in out]})

    return cases.select(*kept).mapInPandas(run, schema)


def token_offsets(text: Column, load: Callable[[], Callable[[str], list[tuple[int, int]]]]) -> Column:
    """An array of (start, end) of a text's tokens, by any tokenizer: ``load`` gives a function from text to its offsets."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for b in batches:
            yield b.map(lambda t: [{"start": a, "end": z} for a, z in tokenizer(t or "")])

    return of(text)


def chunks(notes: DataFrame, offsets: str, size: int, overlap: int) -> DataFrame:
    """id, chunk, start, end, text of ``notes`` (id, text, and an array of token offsets): stretches of ``size`` tokens that share ``overlap``."""
    from attestry.operators.segment import chunk_bounds

    spans = notes.where(F.size(offsets) > 0).select("id", "text", offsets, F.explode(chunk_bounds(F.size(offsets), size, overlap)).alias("c"))
    start, end = F.get(offsets, F.col("c.start")).start, F.get(offsets, F.col("c.end") - 1).end
    return spans.select("id", "c.chunk", start.alias("start"), end.alias("end"), F.substring("text", start + 1, end - start).alias("text"))


def assemble(rows: DataFrame, load: Callable[[], Callable[[str], int]], build: Callable[[dict, list[str]], tuple[str, str]], budgets: tuple[int, int], paragraphs: str = "paragraphs") -> DataFrame:
    """``rows`` with source, source_tokens, chat_tokens, n_paragraphs, error: each row's text with as many of its paragraphs, in order, as two budgets allow.

    ``build`` makes (source, whole chat) of a row's other columns and some of its ``paragraphs``; ``load`` runs once for each task and gives the
    tokenizer's count of a text. ``budgets``: tokens of the chat and of the source. Paragraphs are added until the first with
    which either text is over its budget: what a paragraph costs depends on the text around it, so every candidate is built and counted
    whole. A row that is over a budget without any has that as its error, and no source.
    """
    made = "source string, source_tokens int, chat_tokens int, n_paragraphs int, error string"
    kept = [c for c in rows.columns if c not in (paragraphs, *[m.split()[0] for m in made.split(", ")])]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema], made])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = load()
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                offered, found = list(row.pop(paragraphs) if row[paragraphs] is not None else []), None
                for n in range(len(offered) + 1):
                    source, chat = build(row, offered[:n])
                    sizes = count(source), count(chat)
                    if sizes[1] > budgets[0] or sizes[0] > budgets[1]:
                        break
                    found = source, *sizes, n, None
                out.append(found or (None, None, None, None, f"over a budget without any paragraph: chat {sizes[1]} of {budgets[0]}, source {sizes[0]} of {budgets[1]}"))
            made_ = pd.DataFrame(out, columns=["source", "source_tokens", "chat_tokens", "n_paragraphs", "error"], dtype=object)
            yield pd.concat([b[kept].reset_index(drop=True), made_], axis=1)

    return rows.select(*kept, paragraphs).mapInPandas(run, schema)
