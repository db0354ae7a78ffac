"""Asking a language model for values, around one opaque call.

Only the call itself is Python: prompts go out and replies come back in Arrow
batches; cutting, prompting, reading of replies and merging are expressions.
Providers are objects with ``ask(prompt) -> str``. ``Offline`` answers without
a network, deterministically; the others speak HTTP through a transport that may
be replaced.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions import jsons
from stratafin.functions import text as T

#: Characters of a chunk; tries of one model and the pause after a refusal for too many calls.
CHUNK, TRIES, PAUSE = 6000, 2, 2.0
#: Spellings of providers.
PROVIDERS = {"groq": "groq", "openrouter": "openrouter", "open_router": "openrouter", "google": "google", "gemini": "google"}
#: The instruction of an extraction, before and after its example, and before the text.
ASK = "Извлеки коэффициенты: "
STRICT = "\n\nВерни строго JSON ОБЪЕКТ (только JSON, без пояснений):\n"
RULES = "\n\nЗапрещено:\n- список []\n- любой текст кроме JSON\n\nЕсли значения нет — используй null.\n\nТекст:\n"
#: The instruction of advice and the headings of its parts.
ADVISE = "Ты — профессиональный финансовый аналитик. На основе представленных ниже коэффициентов и предупреждений дай краткие и практические рекомендации (порядок: критично/средний/рекомендации для поддержки).\n"
ADVISE_METRICS, ADVISE_WARNINGS = "Коэффициенты:", "\nПредупреждения:"


class Provider(Protocol):
    def ask(self, prompt: str) -> str: ...


class TooMany(Exception):
    """A provider's refusal for too many calls."""


class Offline:
    """Answers without a network: a number after each asked name in the text, else null."""

    def ask(self, prompt: str) -> str:
        head, _, body = prompt.partition(RULES)
        keys = [k for k in head.partition(ASK)[2].partition(STRICT)[0].split(", ") if k]
        found = {k: re.search(re.escape(k) + r"\D{0,20}?(\d+(?:[.,]\d+)?)", body, re.I) for k in keys}
        return json.dumps({k: m and m.group(1).replace(",", ".") for k, m in found.items()}, ensure_ascii=False)


def http_json(url: str, method: str = "GET", headers: dict[str, str] | None = None, payload: Any = None, timeout: float = 60) -> Any:
    """The JSON a server answers with, {} for an empty answer; an error tells the code and the first 2000 characters of its body."""
    body = None if payload is None else json.dumps(payload, ensure_ascii=False).encode("utf-8")
    asked = urllib.request.Request(url, data=body, method=method.upper(), headers={"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as answer:  # noqa: S310
            text = answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        said = f"HTTP {e.code} calling {url}. Body: {e.read().decode('utf-8', 'replace')[:2000]}"
        raise (TooMany if e.code == 429 else RuntimeError)(said) from e
    return json.loads(text) if text else {}


class Chat:
    """A provider that answers a list of messages (two of the known ones share this form)."""

    def __init__(self, url: str, key: str, model: str, settings: dict[str, Any], headers: dict[str, str] | None = None, transport: Callable[..., Any] = http_json):
        self.url, self.transport = url, transport
        self.headers = {"Authorization": f"Bearer {key}", **(headers or {})}
        self.settings = {"model": model, **settings}

    def ask(self, prompt: str) -> str:
        got = self.transport(self.url, "POST", self.headers, {**self.settings, "messages": [{"role": "user", "content": prompt}]})
        if not got.get("choices"):
            raise RuntimeError(got.get("error", {}).get("message", "Unknown error"))
        return got["choices"][0]["message"]["content"]


def groq(key: str, model: str = "qwen/qwen3-32b", **how) -> Chat:
    return Chat("https://api.groq.com/openai/v1/chat/completions", key, model, {"temperature": 0.6, "top_p": 0.95, "max_tokens": 4096}, **how)


def openrouter(key: str, model: str = "mistralai/mixtral-8x7b-instruct", **how) -> Chat:
    return Chat("https://openrouter.ai/api/v1/chat/completions", key, model, {"temperature": 0.7, "max_tokens": 300}, {"HTTP-Referer": "http://localhost", "X-Title": "fallback-app"}, **how)


class Google:
    def __init__(self, key: str, model: str = "gemini-2.5-flash", transport: Callable[..., Any] = http_json):
        self.key, self.model, self.transport = key, model, transport

    def ask(self, prompt: str) -> str:
        got = self.transport(f"https://generativelanguage.googleapis.com/v1beta/models/{self.model}:generateContent", "POST", {"x-goog-api-key": self.key}, {"contents": [{"parts": [{"text": prompt}]}]})
        return "".join(p.get("text", "") for p in got["candidates"][0]["content"]["parts"])


class Local:
    """A server of models on this machine; a model it does not hold is an error before anything is asked."""

    def __init__(self, model: str, system: str = "", temperature: float = 0.3, host: str = "http://localhost:11434", transport: Callable[..., Any] = http_json):
        self.model, self.system, self.temperature, self.host, self.transport = model, system, temperature, host, transport

    def ask(self, prompt: str) -> str:
        held = {m["name"] for m in self.transport(f"{self.host}/api/tags").get("models", [])}
        if not held & {self.model, f"{self.model}:latest"}:
            raise RuntimeError(f"no model {self.model} here")
        got = self.transport(f"{self.host}/api/generate", "POST", None, {"model": self.model, "prompt": prompt, "system": self.system, "stream": False, "options": {"temperature": self.temperature}})
        if "response" not in got:
            raise RuntimeError("empty answer")
        return got["response"]


def provider(name: str, key: str, model: str, **how) -> Provider:
    """The provider of a name in any known spelling."""
    return {"groq": groq, "openrouter": openrouter, "google": Google}[provider_name(name)](key, model, **how)


class Fallback:
    """The first of several providers that answers; each may refuse ``TRIES`` times."""

    def __init__(self, providers: Sequence[Provider], pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep):
        self.providers, self.pause, self.sleep = list(providers), pause, sleep

    def ask(self, prompt: str) -> str:
        last: Exception | None = None
        for p in self.providers:
            for _ in range(TRIES):
                try:
                    return p.ask(prompt)
                except TooMany as e:
                    last = e
                    self.sleep(self.pause)
                except Exception as e:  # noqa: BLE001
                    last = e
                    break
        raise RuntimeError(f"no provider answered: {last}")


def provider_name(name: str) -> str:
    """The canonical name of a provider; an unknown one is an error."""
    key = name.strip().lower()
    if key not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return PROVIDERS[key]


def first_valid(key: str, providers: Sequence[tuple[str, Callable[[str], bool]]]) -> str | None:
    """The first provider that accepts a key, by (name, check); a check that fails counts as no."""
    for name, check in providers:
        try:
            if check(key):
                return name
        except Exception:  # noqa: BLE001, S112
            continue
    return None


def extraction_prompt(keys: Sequence[str], chunk: Column) -> Column:
    example = json.dumps(dict.fromkeys(keys), ensure_ascii=False)
    return F.rtrim(F.concat(F.lit(ASK + ", ".join(keys) + STRICT + example + RULES), chunk))


def advice_prompt(metric_lines: Column, warning_list: Column) -> Column:
    told = F.concat(F.lit(ADVISE_WARNINGS + "\n"), F.array_join(F.transform(warning_list, lambda w: F.concat(F.lit("- "), w)), "\n"))
    return F.concat_ws("\n", F.lit(ADVISE), F.lit(ADVISE_METRICS), metric_lines, F.when(F.size(warning_list) > 0, told))


def call_model(prompts: DataFrame, provider: Provider, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ok, reply and error; a failed call is a row, not a failed job."""
    at = prompts.columns.index(prompt)
    keep = [c for c in prompts.columns if c not in ("ok", "reply", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, reply, error = [], [], []
            for text in batch.column(at).to_pylist():
                try:
                    answer, why = provider.ask(text), None
                except Exception as e:  # noqa: BLE001
                    answer, why = None, str(e)[:2000]
                ok.append(answer is not None)
                reply.append(answer)
                error.append(why)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(reply, pa.string()), pa.array(error, pa.string())], names=[*keep, "ok", "reply", "error"])

    kinds = ", ".join(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in keep)
    return prompts.select(*keep).mapInArrow(run, f"{kinds}, ok boolean, reply string, error string")


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """(key, chunk_idx, chunk); none for empty and null texts."""
    return docs.select(key, F.posexplode(T.chunks(F.col(text), size)).alias("chunk_idx", "chunk"))


def value_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_idx, chunk): each value at the top of a JSON object, in its order; none for other texts."""
    values = F.map_values(F.from_json(F.col(text), "map<string,string>"))
    return docs.select(key, F.posexplode(values).alias("chunk_idx", "chunk"))


def block_chunks(blocks: DataFrame, key: str = "doc_id", order: Sequence[str] = ("page_number", "block_no"), content: str = "content") -> DataFrame:
    """(key, chunk_idx, chunk): each block's content, numbered from 0 in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    said = blocks.filter(F.col(content).isNotNull())
    return said.select(key, (F.row_number().over(w) - 1).alias("chunk_idx"), F.col(content).alias("chunk"))


def joined_contents(blocks: DataFrame, key: str = "doc_id", order: Sequence[str] = ("page_number", "block_no"), content: str = "content") -> DataFrame:
    """(key, text): the contents of a document's blocks in order, a space between."""
    listed = F.array_sort(F.collect_list(F.struct(*order, content)))
    return blocks.filter(F.col(content).isNotNull()).groupBy(key).agg(F.array_join(F.transform(listed, lambda b: b[content]), " ").alias("text"))


def extract_keys(docs: DataFrame, keys: Sequence[str], provider: Provider | None = None, key: str = "doc_id", text: str = "text", size: int = CHUNK, last_wins: bool = False) -> DataFrame:
    """(key, name, value): what the replies to a document's chunks say; the first known value counts (or the last)."""
    parts = chunked(docs, key, text, size)
    replies = call_model(parts.select(key, "chunk_idx", extraction_prompt(keys, F.col("chunk")).alias("prompt")), provider or Offline())
    said = replies.select(key, "chunk_idx", jsons.object_in(F.col("reply")).alias("m"))
    rows = said.select(key, "chunk_idx", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.try_element_at("m", F.lit(k)).alias("value")) for k in keys])).alias("x"))
    rows = rows.select(key, "chunk_idx", "x.name", "x.value")
    pick = F.max_by if last_wins else F.min_by
    return rows.groupBy(key, "name").agg(pick("value", F.when(F.col("value").isNotNull(), F.col("chunk_idx"))).alias("value"))


def model_ids(payload: Column) -> Column:
    """The models of a provider's list: under data, models or result; by id, name or model; each once, in order."""
    v = F.try_parse_json(payload)
    listed = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("data", "models", "result")], F.try_variant_get(v, "$", "array<variant>"))
    names = F.transform(listed, lambda m: F.regexp_replace(F.coalesce(*[F.try_variant_get(m, f"$.{k}", "string") for k in ("id", "name", "model")]), "^models/", ""))
    return F.array_distinct(F.array_compact(names))


def filtered_ids(ids: Column, needle: str | None) -> Column:
    """Ids that hold a needle in any case; a blank needle keeps all."""
    low = (needle or "").strip().lower()
    return F.filter(ids, lambda i: F.contains(F.lower(i), F.lit(low))) if low else ids
