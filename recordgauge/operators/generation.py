"""Prompt rendering and generation with an injectable client."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def render_prompts(df: DataFrame, instruction: str, given: str, template: Callable[[Column], Column], tokens: Callable[[Column], Column], context: int, max_new: int) -> DataFrame:
    """L1: `prompt`, `prompt_tokens` and whether the prompt is `skipped` as too long."""
    from recordgauge.functions.text import user_text

    out = df.withColumn("prompt", template(user_text(F.col(instruction), F.col(given))))
    out = out.withColumn("prompt_tokens", tokens(F.col("prompt")))
    return out.withColumn("skipped", F.col("prompt_tokens") > context - max_new)


def tagged_grammar(schema: dict, begin: str, end: str) -> str:
    """L3: a grammar (EBNF) of begin tag, newline, JSON of a schema, newline, end tag.

    Covers what `functions.schema` validates: objects in property order, every property
    present, arrays up to maxItems, choices, enumerations, integers, numbers and strings."""
    import json

    rules: dict[str, str] = {}
    quote = lambda s: json.dumps(s, ensure_ascii=False)

    def body(s: dict) -> str:
        if "anyOf" in s:
            return "(" + " | ".join(body(o) for o in s["anyOf"]) + ")"
        if "enum" in s:
            return "(" + " | ".join(quote(json.dumps(v, ensure_ascii=False)) for v in s["enum"]) + ")"
        kind = s.get("type")
        if kind == "object":
            members = [f"{quote(json.dumps(k, ensure_ascii=False) + ': ')} {rule(v)}" for k, v in s.get("properties", {}).items()]
            return f"{quote('{')} " + f" {quote(', ')} ".join(members) + f" {quote('}')}"
        if kind == "array":
            item, most = rule(s["items"]), s.get("maxItems")
            more = f"({quote(', ')} {item})" + ("*" if most is None else f"{{0,{most - 1}}}")
            return f"({quote('[]')} | {quote('[')} {item} {more} {quote(']')})"
        return {"integer": "integer", "number": "number", "null": quote("null"), "boolean": f"({quote('true')} | {quote('false')})"}.get(kind, "string")

    def rule(s: dict) -> str:
        text = body(s)
        if len(text) < 40:
            return text
        name = next((n for n, t in rules.items() if t == text), f"r{len(rules)}")
        rules[name] = text
        return name

    main = rule(schema)
    base = {"integer": '"-"? ("0" | [1-9] [0-9]*)', "number": 'integer ("." [0-9]+)?', "string": '"\\"" ([^"\\\\] | "\\\\" ["\\\\/bfnrt])* "\\""'}
    lines = [f"root ::= {quote(begin + chr(10))} {main} {quote(chr(10) + end)}", *[f"{n} ::= {t}" for n, t in rules.items()], *[f"{n} ::= {t}" for n, t in base.items()]]
    return "\n".join(lines)


def white_space_tokens(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda t: t != ""))


def generate(df: DataFrame, client: Callable[[str], str], prompt: str = "prompt", attempts: int = 3, pause: float = 1.5, threads: int = 4) -> DataFrame:
    """L2: `completion` for each prompt: up to `attempts` tries with a linear pause; a prompt that fails fails the job."""
    schema = T.StructType([*df.schema.fields, T.StructField("completion", T.StringType())])

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        def ask(text: str) -> str:
            for k in range(1, attempts + 1):
                try:
                    return client(text)
                except Exception:
                    if k == attempts:
                        raise
                    time.sleep(pause * k)
            raise AssertionError

        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                got = list(pool.map(ask, b.column(prompt).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
