"""Whether a JSON value has the shape of a contract: names, types, closed lists and bounds, place by place.

JSON readers drop unknown names and turn what doesn't fit into null, so an artifact's own text is walked, one row (file)
at a time on the executors. What the rules in ``contracts`` compare across values (V1 to V12) is no matter of shape.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

from . import schemas as S

Fault = tuple[str, str, str]  # rule, place, message


def _number(x: Any) -> bool:
    return type(x) is int or type(x) is float and math.isfinite(x)  # an int of any length is finite


def _whole(x: Any) -> bool:
    return _number(x) and x == int(x)


def _moment(x: str) -> bool:
    try:
        datetime.fromisoformat(x)
    except ValueError:
        return False
    return "T" in x or " " in x


def _matches(pattern: str) -> Callable[[str], bool]:
    return re.compile(pattern.removeprefix("^").removesuffix("$")).fullmatch


def _safe(x: str) -> bool:
    return 0 < len(x) <= 500 and not x.startswith("/") and "\\" not in x and ".." not in x.split("/")


#: kind: (whether the type is right, whether the value is, the type's name)
LEAVES: dict[str, tuple[Callable, Callable, str]] = {
    name: (kind, good, said)
    for kind, said, leaves in (
        (lambda x: isinstance(x, str), "a string", {"string": lambda x: True, "text": bool, "name": lambda x: 0 < len(x) <= 200, "identifier": _matches(S.IDENTIFIER), "revision": _matches(S.REVISION), "version": _matches(r"\d+\.\d+\.\d+"), "sha256": _matches("[0-9a-fA-F]{64}"), "moment": _moment, "path": _safe}),
        (_whole, "a whole number", {"count": lambda x: x >= 0, "positive": lambda x: x > 0}),
        (_number, "a number", {"amount": lambda x: x >= 0, "extent": lambda x: x > 0, "share": lambda x: 0 <= x <= 1}),
        (lambda x: isinstance(x, bool), "true or false", {"boolean": lambda x: True}),
        (lambda x: isinstance(x, dict), "an object", {"open": lambda x: all(isinstance(v, str | bool) or _number(v) for v in x.values())}),
    )
    for name, good in leaves.items()
}


#: A check gives the faults of a value, with places from it on; most values have none, so a place is written only on the way back from a fault.
Check = Callable[[Any], "list[Fault] | tuple[()]"]


def faults(value: Any, shape: Any, place: str = "$") -> Iterator[Fault]:
    """All places where a parsed value departs from a shape (see schemas.SHAPES)."""
    return ((rule, place + at, said) for rule, at, said in _check_of(shape)(value))


def _check_of(shape: Any) -> Check:
    if isinstance(shape, str):
        return _named(shape)
    if isinstance(shape, tuple):
        return _one_of(shape)
    if isinstance(shape, list):
        return _list_of(_check_of(shape[0]), shape[1] if len(shape) > 1 else 0)
    return _any_names(_check_of(shape["*"])) if "*" in shape else _members(shape)


@functools.cache
def _named(name: str) -> Check:
    return _leaf(name, *LEAVES[name]) if name in LEAVES else _check_of(S.SHAPES[name])


def _leaf(name: str, kind: Callable, good: Callable, said: str) -> Check:
    wrong_type, wrong_value = [("type", "", f"not {said}")], [("value", "", f"no {name}")]
    return lambda value: wrong_type if not kind(value) else () if good(value) else wrong_value


def _one_of(allowed: tuple[str, ...]) -> Check:
    known, wrong = frozenset(allowed), [("value", "", f"not one of {', '.join(allowed)}")]
    return lambda value: () if isinstance(value, str) and value in known else wrong


def _below(step: str, found: list[Fault]) -> list[Fault]:
    return [(rule, step + at, said) for rule, at, said in found]


def _list_of(inner: Check, least: int) -> Check:
    def check(value: Any) -> list[Fault] | tuple[()]:
        if not isinstance(value, list):
            return [("type", "", "not a list")]
        out = [("value", "", "an empty list")] if len(value) < least else []
        for i, x in enumerate(value):
            if found := inner(x):
                out += _below(f"[{i}]", found)
        return out

    return check


def _any_names(inner: Check) -> Check:
    def check(value: Any) -> list[Fault] | tuple[()]:
        if not isinstance(value, dict):
            return [("type", "", "not an object")]
        return [fault for name, x in value.items() if (found := inner(x)) for fault in _below(f".{name}", found)]

    return check


def _members(shape: dict) -> Check:
    inner = {name.rstrip("?~!"): (_check_of(x), name[-1] not in "?~", name[-1] in "?!") for name, x in shape.items()}

    def check(value: Any) -> list[Fault] | tuple[()]:
        if not isinstance(value, dict):
            return [("type", "", "not an object")]
        out = [("closed", f".{name}", "unknown key") for name in value.keys() - inner.keys()]
        for name, (of, required, nullable) in inner.items():
            if name not in value:
                if required:
                    out.append(("required", f".{name}", "missing"))
            elif not (nullable and value[name] is None) and (found := of(value[name])):
                out += _below(f".{name}", found)
        return out

    return check


def text_faults(text: str | None, kind: str) -> Iterator[Fault]:
    """The faults of an artifact's text."""
    try:
        value = json.loads(text or "")
    except (ValueError, RecursionError):
        yield "object", "$", "not JSON"
        return
    if isinstance(value, dict):
        yield from faults(value, kind)
    else:
        yield "object", "$", "not a JSON object"
