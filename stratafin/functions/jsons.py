"""Tolerant reading of JSON replies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strict_object(text: Column) -> Column:
    """A text that is one JSON object and nothing else, as a map of strings; else null.

    The parsers accept what follows a value, so the text is wrapped and a
    sentinel behind it must be found again.
    """
    wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"end":true}'))
    got = F.from_json(wrapped, "v map<string,string>, end boolean", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    is_object = F.startswith(F.ltrim(F.regexp_replace(text, r"(?U)^\s+", "")), F.lit("{"))
    return F.when(is_object & got["end"], got["v"])


def is_json(text: Column) -> Column:
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"end":true}')))
    return F.coalesce(F.try_variant_get(whole, "$.end", "boolean"), F.lit(False))


def object_in(text: Column) -> Column:
    """The object of a reply: the whole text, else its widest span in braces or brackets; else an empty map.

    A reply that is valid JSON but no object, a list of objects and two objects
    side by side all give the empty map.
    """
    span = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    inner = F.when(~is_json(text), strict_object(span))
    return F.coalesce(strict_object(text), inner, F.create_map().cast("map<string,string>"))


def merged(maps: Column) -> Column:
    """A list of maps as one; later keys win."""
    keys = F.array_distinct(F.flatten(F.transform(maps, F.map_keys)))
    last = lambda k: F.try_element_at(F.filter(F.reverse(maps), lambda m: F.map_contains_key(m, k)), F.lit(1))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(last(k), k).alias("value"))))


def value_in(text: Column) -> Column:
    """The JSON value of a reply, lists too: the whole text, else its widest span in braces or brackets; null if neither is JSON."""

    def strict(t: Column) -> Column:
        whole = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit(',"end":true}')))
        return F.when(F.try_variant_get(whole, "$.end", "boolean"), F.try_variant_get(whole, "$.v", "variant"))

    return F.coalesce(strict(text), strict(F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)))


def merged_value(text: Column) -> Column:
    """A reply as one map of strings: an object as it is, the objects of a list merged (later keys win), else the empty map."""
    kind = "map<string,string>"
    v = value_in(text)
    own = F.try_variant_get(v, "$", kind)
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", kind))
    return F.coalesce(own, merged(F.filter(listed, lambda m: m.isNotNull())), F.create_map().cast(kind))


@F.pandas_udf(StringType())
def pretty_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON with an indent of two and its characters kept; null for what is no JSON. No built-in writes this layout."""

    def dumped(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2)
        except ValueError:
            return None

    for s in texts:
        yield pd.Series([dumped(t) for t in s], dtype="object")
