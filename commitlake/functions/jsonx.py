"""Strict JSON objects as columns.

``from_json`` accepts text after the object and reads an array's first element as the object. Wrapping the text in
brackets and asking for exactly one element rejects both, and every torn line with them, in one pass of the parser.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPTIONS = {"allowSingleQuotes": "false"}


def json_object(text: Column, fields: str) -> Column:
    """Struct ``fields`` (DDL) of the one JSON object in ``text``; NULL where it is anything else.

    Fields of type STRING hold decoded strings, or the JSON text of other values. Missing and null fields are NULL;
    a repeated key counts with its last value; a struct field over another kind of value is NULL. Records nested deeper
    than the parser goes (1,000 levels) are NULL; ``parse_object`` reads any depth.
    """
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{fields}>>", _OPTIONS)
    return F.when(F.size(parsed) == 1, parsed[0])


def json_value(text: Column, kind: str) -> Column:
    """JSON ``text`` of a field as ``kind`` (DDL); NULL where it does not parse as that."""
    return F.from_json(text, kind, _OPTIONS)


def _refuse(name: str) -> float:
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse)
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null", re.ASCII)


def parse_object(text: str | None) -> dict | None:
    """The JSON object in ``text``, or None for anything else: other values, torn lines, text after the object, NaN."""
    if not text:
        return None
    try:
        value = _DECODER.decode(text)
    except RecursionError:
        try:
            value = _parse_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _parse_deep(text: str) -> object:
    """The JSON value in ``text`` by a stack instead of recursion, for nesting of any depth; ValueError for no JSON."""
    skip = lambda at: _SPACE.match(text, at).end()

    def key_at(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("no key")
        key, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError("no colon")
        return key, skip(at + 1)

    held: list[dict | list] = []
    keys: list[str] = []  # the key each open container waits for a value of; "" for an array
    at = skip(0)
    while True:
        sign = text[at : at + 1]
        value: object
        if sign in ("{", "["):
            value = {} if sign == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != "}]"["{[".index(sign)]:
                held.append(value)
                keys.append("")
                if sign == "{":
                    keys[-1], at = key_at(at)
                continue
            at += 1
        elif sign == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            scalar = _SCALAR.match(text, at)
            if scalar is None:
                raise ValueError("no value")
            value, at = json.loads(scalar[0]), scalar.end()
        while True:  # put the finished value into the container around it, and that one into the next where it ends
            at = skip(at)
            if not held:
                if at != len(text):
                    raise ValueError("text after the value")
                return value
            around = held[-1]
            if isinstance(around, dict):
                around[keys[-1]] = value
            else:
                around.append(value)
            sign = text[at : at + 1]
            if sign == ",":
                at = skip(at + 1)
                if isinstance(around, dict):
                    keys[-1], at = key_at(at)
                break
            if sign != ("}" if isinstance(around, dict) else "]"):
                raise ValueError("not closed")
            value = held.pop()
            keys.pop()
            at += 1


def sound(text: str | None) -> str | None:
    """``text`` with lone surrogates, which no file can hold, as question marks."""
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def text_array(values: Iterable[str | None]) -> pa.Array:
    """Arrow array of texts that came out of JSON."""
    values = list(values)
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array(list(map(sound, values)), pa.string())
