"""Per-row model jobs: prompt plans, token estimates, request keys, and a deterministic echo answer.

A prompt is one Column: the template is cut at plan time and every cell is wrapped as untrusted
text, so rendering runs inside code generation.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from itertools import zip_longest
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from millrace.errors import InvalidInput
from millrace.functions.expressions import col
from millrace.operators.governance import untrusted_block
from millrace.operators.labels import strictest
from millrace.session import require_columns

# Placeholders, system texts, default output names and answer caps per mode; names of cells.
PLACEHOLDER = r"\{([A-Za-z_][A-Za-z0-9_ .-]*)\}"
SYSTEM = {
    "prompt": "Answer using only the data provided. Reply with the answer alone.",
    "classify": "Classify the data provided into exactly one of the given labels. "
                "Reply with the label alone, and nothing else.",
    "extract": "Extract the requested fields from the data provided. "
               "Reply with JSON only, matching the given schema. Use null for anything absent.",
    "summarize": "Summarise the data provided. Reply with the summary alone.",
}
OUTPUT = {"prompt": "llm_output", "classify": "label", "extract": "extracted", "summarize": "summary"}
MAX_TOKENS = {"prompt": 512, "classify": 16, "extract": 512, "summarize": 256}
CHARS_PER_TOKEN = 4
LABEL_CHARS = 40
LABEL_ALPHABET = string.ascii_letters + string.digits + "_-"
NON_CACHEABLE_PURPOSES = ("guardrail", "eval")


@dataclass(frozen=True)
class Plan:
    mode: str
    system: str
    template: str
    output: str
    columns: tuple[str, ...]
    schema: dict[str, Any] | None
    labels: tuple[str, ...]
    max_tokens: int


def cut(template: str) -> list[tuple[str, str | None]]:
    """A template as pairs of a text and the column that follows it; the last has none."""
    parts = re.split(PLACEHOLDER, template)
    return list(zip_longest(parts[::2], parts[1::2]))


def plan(df: DataFrame, mode: str, template: str, output: str | None = None, labels: list[str] | None = None,
         schema: dict[str, Any] | None = None, max_sentences: int | None = None,
         max_tokens: int | None = None) -> Plan:
    """A checked prompt plan. All that is wrong with it is said in one error."""
    columns = tuple(dict.fromkeys(c for _, c in cut(template or "") if c))
    chosen = tuple(map(str, labels or ())) if mode == "classify" else ()
    name = output or OUTPUT.get(mode, "")
    faults = {
        f"mode must be one of {tuple(SYSTEM)}": mode not in SYSTEM,
        "the template names no column; write {column}": not columns,
        f"output column {name!r} is empty or already on the input": not name.strip() or name in df.columns,
        "classify needs at least two different labels": mode == "classify" and not 1 < len(set(chosen)) == len(chosen),
        "extract needs a schema": mode == "extract" and not (schema and isinstance(schema, dict)),
    }
    if any(faults.values()):
        raise InvalidInput("; ".join(fault for fault, holds in faults.items() if holds))
    require_columns(df, columns)
    added = {"classify": f"\nLabels: {', '.join(chosen)}.", "extract": f"\nSchema: {schema}.",
             "summarize": "" if max_sentences is None else f" Use at most {int(max_sentences)} sentences."}
    shape = {"classify": {"type": "string", "enum": list(chosen)}, "extract": schema}
    return Plan(mode, SYSTEM[mode] + added.get(mode, ""), template, name, columns, shape.get(mode), chosen,
                max_tokens or MAX_TOKENS[mode])


def cell_label(column: str) -> str:
    """What a cell's block is called: the column's name in characters that can't end the delimiter."""
    return "".join(c if c in LABEL_ALPHABET else "_" for c in column[:LABEL_CHARS]) or "cell"


def render(df: DataFrame, prompt: Plan) -> Column:
    """The user message: the template with each cell in an untrusted block; NULL is an empty cell."""
    shown = lambda c: untrusted_block(F.coalesce(col(df, c).cast("string"), F.lit("")), cell_label(c))
    return F.concat(*(part for text, column in cut(prompt.template)
                      for part in ([F.lit(text)] if text else []) + ([shown(column)] if column else [])))


def floors(df: DataFrame, labels: str, dataset_label: str) -> Column:
    """Strictest label over the columns each request sends, for a table of requests: an array column of column
    labels plus a dataset label, which an unlabelled column takes."""
    everyone = F.concat(F.array(F.col(dataset_label)),
                        F.transform(F.col(labels), lambda x: F.coalesce(x, F.col(dataset_label))))
    return strictest(everyone)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; empty or NULL is 0."""
    size = F.coalesce(F.length(text), F.lit(0))
    return F.floor((size + CHARS_PER_TOKEN - 1) / CHARS_PER_TOKEN).cast("bigint")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint")


def echo(system: Column, user: Column, max_tokens: int, labels: tuple[str, ...] = ()) -> Column:
    """A deterministic answer: struct<content, tokens_in, tokens_out>.

    The digest of the whole prompt picks a label, or precedes an echo of the user text cut at eight
    characters per allowed token.
    """
    prompt = F.concat_ws("\n", system, user)
    digest = F.substring(F.sha2(prompt, 256), 1, 8)
    if labels:
        place = F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(len(labels)))
        content = F.element_at(F.array(*map(F.lit, labels)), (place + 1).cast("int"))
    else:
        content = F.substring(F.concat(F.lit("echo["), digest, F.lit("] "), user), 1, max_tokens * 8)
    return F.struct(content.alias("content"), word_count(prompt).alias("tokens_in"),
                    word_count(content).alias("tokens_out"))


def request_key(model: str, max_tokens: int, temperature: float, system: Column, user: Column,
                project: Column, connection: Column) -> Column:
    """sha256 of the canonical request: sorted keys, compact, project included, redacted text."""
    message = lambda role, text: F.struct(text.alias("content"), F.lit(role).alias("role"))
    body = F.struct(
        connection.alias("connection_id"), F.lit(max_tokens).alias("max_tokens"),
        F.array(message("system", system), message("user", user)).alias("messages"),
        F.lit(model).alias("model"), project.alias("project_id"),
        F.lit(f"{temperature:.4f}").alias("temperature"),
    )
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def cacheable(ttl_seconds: Column | int, purpose: Column | str, temperature: Column | float) -> Column:
    """Only a temperature of 0 with a lifetime, and never a guardrail or eval call."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return ((as_col(ttl_seconds) > 0) & ~as_col(purpose).isin(*NON_CACHEABLE_PURPOSES)
            & (as_col(temperature) == 0))
