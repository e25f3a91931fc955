"""Model interfaces with deterministic stand-ins: an embedder is a column expression, a chat provider a function per partition."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .functions import text as T
from .registry import CHATS, EMBEDDERS
from .settings import DIM

BATCH_TEXTS, BATCH_CHARS = 32, 60_000


@EMBEDDERS.register("hashed")
def hashed(text: Column, dim: int = DIM) -> Column:
    """The unit vector of a hashed bag of words; a text without words is the first unit vector."""
    slot = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int")
    places = F.array(*map(F.lit, range(dim)))
    counted = F.transform(F.array(F.transform(T.words(text), slot)), lambda ws: F.transform(places, lambda i: F.size(F.filter(ws, lambda w: w == i)).cast("double")))[0]
    first = F.array(*(F.lit(float(i == 0)) for i in range(dim)))
    return F.when(F.size(T.words(text)) > 0, T.truncate_normalise(counted, dim)).otherwise(first)


def batches(texts: list[str]) -> Iterator[list[str]]:
    """Parts of at most 32 texts and 60,000 characters; a longer text is a part alone."""
    part: list[str] = []
    for t in texts:
        if part and (len(part) == BATCH_TEXTS or sum(map(len, part)) + len(t) > BATCH_CHARS):
            yield part
            part = []
        part.append(t)
    if part:
        yield part


def served(embed: Callable[[list[str]], list[list[float]]], dim: int, prefix: str = "") -> Callable[[Column], Column]:
    """An embedder backed by a model server, called in batches from Arrow batches; vectors are cut to ``dim`` and normalised."""

    @F.pandas_udf("array<double>")
    def call(texts: pd.Series) -> pd.Series:
        return pd.Series([v for part in batches([prefix + (t or "") for t in texts]) for v in embed(part)])

    return lambda text: T.truncate_normalise(call(text), dim)


@CHATS.register("scripted")
def scripted(replies: dict[str, str], default: str = "") -> Callable[[str], str]:
    """Answers a prompt with the reply of the first key that it holds."""
    return lambda prompt: next((v for k, v in replies.items() if k in prompt), default)


def chat(prompts: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """``prompts`` (.., prompt) with ``answer``; a prompt is asked once for each row."""

    @F.pandas_udf("string")
    def ask(p: pd.Series) -> pd.Series:
        return p.map(lambda x: answer(x or ""))

    return prompts.withColumn("answer", ask("prompt"))


def json_answers(answers: DataFrame, schema: str) -> DataFrame:
    """``answers`` with ``parsed``: the answer read by a schema, null where it doesn't fit."""
    return answers.withColumn("parsed", F.from_json("answer", schema, {"mode": "PERMISSIVE"}))


def requirements_schema() -> str:
    return "requirements array<struct<text:string,kind:string,category:string,years:int>>"


def as_json(**values: object) -> str:
    return json.dumps(values, ensure_ascii=False)


# What an embedding model is told before a query and a document, and the similarity below which a match is hardly one, by model family.
PROFILES = {
    "qwen3-embedding": ("Instruct: Given a search query, retrieve relevant code and text passages that answer the query\nQuery: ", "", 0.50), "bge-m3": ("", "", 0.53), "nomic-embed-text": ("search_query: ", "search_document: ", 0.60),
    "mxbai-embed-large": ("Represent this sentence for searching relevant passages: ", "", 0.54), "embeddinggemma": ("task: search result | query: ", "title: none | text: ", 0.30),
}


def with_prefix(texts: DataFrame, profiles: DataFrame, kind: str) -> DataFrame:
    """``texts`` (model, text) with ``prefixed``: the prefix of the model's profile (model, query_prefix, document_prefix) before the text.

    A profile with a tag is that of one model, one without a tag that of its whole family; the exact one wins, and models without one have none.
    """
    keyed = profiles.select(F.when(F.col("model").contains(":"), T.model_name(F.col("model"))).otherwise(F.lower(F.trim("model"))).alias("__key"), F.col(f"{kind}_prefix").alias("__prefix"))
    exact, family = keyed.toDF("__m", "__pe"), keyed.toDF("__f", "__pf")
    named = texts.withColumn("__m", T.model_name(F.col("model"))).withColumn("__f", T.model_family(F.col("model")))
    found = named.join(exact, "__m", "left").join(family, "__f", "left")
    return found.select(*texts.columns, F.concat(F.coalesce("__pe", "__pf", F.lit("")), "text").alias("prefixed"))


def capabilities(models: DataFrame) -> DataFrame:
    """(model, capabilities): one sorted list for each model of (model, capability) rows."""
    return models.groupBy(T.model_name(F.col("model")).alias("model")).agg(F.sort_array(F.collect_set("capability")).alias("capabilities"))


def resolve_models(roles: DataFrame, wishes: DataFrame, installed: DataFrame) -> DataFrame:
    """(role, model, rule): of the models wished for a role (role, model, rule, place) the first that is installed (model, fits, size): pinned, then override, then the catalog's order if it fits; else the largest that fits."""
    order = F.when(F.col("rule") == "pinned", 0).when(F.col("rule") == "override", 1).otherwise(2)
    have = installed.select(T.model_name(F.col("model")).alias("key"), "model", "fits", "size")
    wished = wishes.select("role", T.model_name(F.col("model")).alias("key"), "rule", "place").join(have, "key").where((F.col("rule") != "catalog") | F.col("fits"))
    ranked = wished.select("role", "model", "rule", F.struct(order.alias("o"), "place", "model").alias("rank"))
    # the largest is one row for all roles
    largest = have.where("fits").agg(F.max_by("model", F.struct("size", "model")).alias("model"))
    last = roles.select("role").join(F.broadcast(largest)).where("model IS NOT NULL").select("role", "model", F.lit("largest").alias("rule"), F.struct(F.lit(3).alias("o"), F.lit(0).cast(dict(wishes.dtypes)["place"]).alias("place"), "model").alias("rank"))
    best = ranked.union(last).groupBy("role").agg(F.min_by(F.struct("model", "rule"), "rank").alias("m"))
    return best.select("role", "m.model", "m.rule")


def speed_test(embed: Callable[[list[str]], list[list[float]]], answer: Callable[[str], str], *, texts: int = 16, least_texts: float = 5.0, least_tokens: float = 8.0) -> dict[str, float | bool]:
    """Texts embedded and tokens answered a second after one call of each to warm up, and whether both are fast enough."""
    from time import perf_counter

    embed(["warm up"])
    answer("warm up")
    began = perf_counter()
    embed([f"text {i}" for i in range(texts)])
    embedded = texts / max(perf_counter() - began, 1e-9)
    began = perf_counter()
    tokens = -(-len(answer("count to a hundred")) // 4)
    answered = tokens / max(perf_counter() - began, 1e-9)
    return {"texts_per_second": embedded, "tokens_per_second": answered, "fast": embedded >= least_texts and answered >= least_tokens}
