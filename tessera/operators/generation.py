"""What surrounds the models: prompts, answers with one retry, chunking and classifying by a model.

Every call goes through a TextModel or VisionModel inside Arrow batches, a batch's prompts
together where the model takes them so; the stand-ins make all of it run, and repeat, offline.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import responses as R
from tessera.functions import text as T
from tessera.functions.models import TextModel, VisionModel, accept_description, accept_rewrite, complete_all
from tessera.operators.chunking import CHUNK_COLUMNS, CHUNK_SCHEMA, LEAST

LEAST_ANSWER = 30
RULE = "─" * 72


def context_block(ranked: DataFrame) -> DataFrame:
    """(query_id, context) of (query_id, rank, source_name, chunk_type, text): labelled passages in rank order, cut to size."""
    kind = F.when(F.col("chunk_type") == "visual", " | VISUAL CONTENT").otherwise("")
    passage = F.concat(F.lit("[SOURCE: "), "source_name", kind, F.lit("]\n"), T.truncate_context(F.col("text")), F.lit("\n[/SOURCE: "), "source_name", F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct("rank", passage.alias("passage"))))
    return ranked.groupBy("query_id").agg(F.array_join(rows["passage"], "\n\n").alias("context"))


def prompt(question: Column, context: Column, history: Column, memory: Column, patches: Column) -> Column:
    """The blocks of a prompt in order; missing ones are left out."""
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(some(history), some(memory), F.lit(f"<<CONTEXT_BLOCK>>\n{RULE}\n"), some(context), F.lit(f"\n{RULE}\n\n<<USER_QUESTION>>\n"), some(question), F.lit("\n"), some(patches))


def _ends(text: str) -> bool:
    return bool(re.search(r"[.!?)\]`*|\-\w]\s*$", text))


def answers(model: TextModel, prompts: list[str]) -> list[str]:
    """An answer each; where it is short or breaks off, a second one, unless that is an error."""
    out = complete_all(model, prompts)
    again = [i for i, a in enumerate(out) if not a.startswith("❌") and (len(a.strip()) < LEAST_ANSWER or not _ends(a))]
    for i, second in zip(again, complete_all(model, [prompts[i] for i in again])):
        if second and not second.startswith("❌"):
            out[i] = second
    return out


def generate(prompts: DataFrame, model: TextModel) -> DataFrame:
    """(query_id, response) of (query_id, prompt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf.query_id, "response": answers(model, pdf.prompt.tolist())})

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {prompts.schema['query_id'].dataType.simpleString()}, response string")


def rewrite(queries: DataFrame, model: TextModel) -> DataFrame:
    """queries (query_id, text, turns_before, history) with text rewritten where it is a follow-up; the model sees no others."""
    asks = T.is_followup(F.col("text"), F.col("turns_before"))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = complete_all(model, [f"Conversation:\n{h}\n\nFollow-up: {t}\nStandalone query:" for h, t in zip(pdf.history, pdf.text)])
            yield pd.DataFrame({"query_id": pdf.query_id, "text": [accept_rewrite(t, s) for t, s in zip(pdf.text, said)]})

    new = queries.where(asks).select("query_id", "text", "history").mapInPandas(run, f"query_id {kind}, text string")
    return queries.where(~asks).select("query_id", "text").unionByName(new)


def classify(queries: DataFrame, model: TextModel, taxonomy: str) -> DataFrame:
    """(query_id, action, confidence, ...) of (query_id, text): a model's intents, checked; null where it gave none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf.query_id, "raw": complete_all(model, pdf.text.tolist(), taxonomy)})

    raw = queries.select("query_id", "text").mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, raw string")
    return raw.withColumn("i", R.intent_column(F.col("raw"))).select("query_id", "i.*")


def page_chunks(answer: str | None) -> list[dict] | None:
    """The chunks of a model's answer, by the first reading that gives any; null if none does."""
    text = re.sub(r"```(?:json)?\s*", "", re.sub(r"(?s)<think>.*?(?:</think>|\Z)", "", answer or "")).strip()
    a, b = text.find("["), text.rfind("]")
    fixed = R.repair_json(text[a : b + 1]) if 0 <= a < b else None
    items = json.loads(fixed) if fixed else json.loads(R.complete_objects(text, LEAST)) or None
    return [i for i in items if isinstance(i, dict)] if items is not None else None


def chunks_by_model(docs: DataFrame, model: TextModel) -> DataFrame:
    """Chunks of (source_key, source_name, text) as a model cuts them, page by page; a page whose two answers can't be read stays whole."""
    pages = docs.select("source_key", "source_name", F.posexplode(T.pack_sentences(F.coalesce("text", F.lit("")))).alias("page", "text")).withColumn("text", T.sanitize(F.col("text"))).where(F.length("text") >= LEAST)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, texts = [], pdf.text.tolist()
            cut = [page_chunks(a) for a in complete_all(model, texts)]
            again = [i for i, c in enumerate(cut) if c is None]
            for i, a in zip(again, complete_all(model, [texts[i] for i in again])):
                cut[i] = page_chunks(a)
            for key, name, page, text, found in zip(pdf.source_key, pdf.source_name, pdf.page, texts, cut):
                for i, c in enumerate([{"content": text}] if found is None else found):
                    if len(content := str(c.get("content", "")).strip()) >= LEAST:
                        rows.append((key, name, str(c.get("part", "")), "", "", str(c.get("section", "")), str(c.get("section_title", "")), content, (int(page) << 20) + i))
            yield pd.DataFrame(rows, columns=[*CHUNK_COLUMNS, "chunk_no"])

    return pages.mapInPandas(run, CHUNK_SCHEMA)


def chunks_of_images(images: DataFrame, vision: VisionModel, model: TextModel) -> DataFrame:
    """Chunks of (source_key, source_name, mime, content) rows: text read off each image, cleaned and cut by a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"source_key": pdf.source_key, "source_name": pdf.source_name, "text": [vision.read(c, m) for c, m in zip(pdf.content, pdf.mime)]})

    read = images.select("source_key", "source_name", "mime", "content").mapInPandas(run, "source_key string, source_name string, text string")
    return chunks_by_model(read.withColumn("text", T.clean_text(F.col("text"))).where(F.length("text") >= LEAST), model)


def describe(images: DataFrame, vision: VisionModel) -> DataFrame:
    """(id, description) of (id, mime, content): descriptions of five words or more, else empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "description": [accept_description(vision.read(c, m)) for c, m in zip(pdf.content, pdf.mime)]})

    return images.select("id", "mime", "content").mapInPandas(run, f"id {images.schema['id'].dataType.simpleString()}, description string")


def reflect(turns: DataFrame, model: TextModel) -> DataFrame:
    """(qa_id, root_agent, suggested_intent, suggested_sections) of (qa_id, query, response): a model's view of what failed, `unknown` where it can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            said = complete_all(model, [f"Query: {q}\nResponse: {r[:400]}" for q, r in zip(pdf["query"], pdf["response"])])
            for i, answer in zip(pdf["qa_id"], said):
                text = re.sub(r"(?s)<think>.*?</think>", "", answer)
                found = re.search(r"\{.*\}", re.sub(r"```(?:json)?", "", text), re.S)
                got = json.loads(R.repair_json(found[0]) or "{}") if found else {}
                rows.append((i, str(got.get("root_agent", "unknown")), str(got.get("suggested_intent", "")), [str(s) for s in got.get("suggested_sections") or []]))
            yield pd.DataFrame(rows, columns=["qa_id", "root_agent", "suggested_intent", "suggested_sections"])

    return turns.select("qa_id", "query", "response").mapInPandas(run, "qa_id string, root_agent string, suggested_intent string, suggested_sections array<string>")
