"""Requests and collection descriptions, parsed from JSON with the engine's errors."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from lexmill.errors import InvalidFormat

TOP_K = 50
NAME = re.compile(r"[a-zA-Z_$][a-zA-Z0-9_]*")


def loads(text: str | dict) -> dict[str, Any]:
    """A JSON object; anything else is an InvalidFormat."""
    if isinstance(text, dict):
        return text
    try:
        value = json.loads(text)
    except (ValueError, TypeError) as e:
        raise InvalidFormat(f"bad JSON: {e}") from None
    if not isinstance(value, dict):
        raise InvalidFormat("the root must be an object")
    return value


@dataclass(frozen=True)
class SortKey:
    field: str
    ascending: bool


@dataclass(frozen=True)
class Query:
    """What to look for, where, with which weights, and by what to sort."""

    text: str
    fields: tuple[str, ...]
    boosts: tuple[float, ...]
    sort: tuple[SortKey, ...] = ()

    @classmethod
    def parse(cls, request: str | dict) -> Query:
        body = loads(request)
        text, fields = body.get("query"), body.get("query by")
        if not isinstance(text, str):
            raise InvalidFormat("query must be a string")
        if not isinstance(fields, list) or not all(isinstance(f, str) for f in fields):
            raise InvalidFormat("query by must be an array of strings")
        boosts = body.get("boost", [1] * len(fields))
        if not isinstance(boosts, list) or len(boosts) != len(fields) or not all(isinstance(b, int | float) and not isinstance(b, bool) and b >= 0 for b in boosts):
            raise InvalidFormat("boost must hold a number of at least 0 for each field")
        keys = body.get("sort by", [])
        if not isinstance(keys, list):
            raise InvalidFormat("sort by must be an array")
        return cls(text, tuple(fields), tuple(map(float, boosts)), tuple(map(cls.sort_key, keys)))

    @staticmethod
    def sort_key(text: Any) -> SortKey:
        name, found, order = text.partition(":") if isinstance(text, str) else ("", "", "")
        if not name or not found or order not in ("asc", "ascend", "desc", "descend"):
            raise InvalidFormat(f"{text!r} is not field:asc or field:desc")
        return SortKey(name, order.startswith("asc"))


@dataclass(frozen=True)
class SuggestConfig:
    entries: int = 5
    min_gram: int = 2
    max_gram: int = 15


@dataclass(frozen=True)
class CollectionMeta:
    """A collection as it was asked for."""

    name: str
    schema: dict[str, Any]
    tokenizer: str = "default"
    suggest: SuggestConfig | None = None
    raw: dict[str, Any] = field(default_factory=dict, compare=False)

    @classmethod
    def parse(cls, request: str | dict) -> CollectionMeta:
        body = loads(request)
        name, schema = body.get("name"), body.get("schema")
        if not isinstance(name, str) or not NAME.fullmatch(name):
            raise InvalidFormat(f"{name!r} is no collection name")
        if not isinstance(schema, dict):
            raise InvalidFormat("schema must be an object")
        tokenizer = body.get("tokenizer", "default")
        if not isinstance(tokenizer, str):
            raise InvalidFormat("tokenizer must be a string")
        suggest = body.get("auto_suggestion")
        if suggest is not None:
            if not isinstance(suggest, dict):
                raise InvalidFormat("auto_suggestion must be an object")
            numbers = [suggest.get(k, d) for k, d in (("entry_num", 5), ("min_gram", 2), ("max_gram", 15))]
            if not all(isinstance(n, int) and n > 0 for n in numbers):
                raise InvalidFormat("auto_suggestion holds positive integers")
            suggest = SuggestConfig(*numbers)
        return cls(name, schema, tokenizer, suggest, body)
