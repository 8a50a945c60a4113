"""Named tools over DataFrames: arguments are checked, errors come back as data."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# JSON names of the types of arguments.
JSON_TYPES = {float: "number", int: "integer", str: "string", bool: "boolean"}


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable[..., Any]
    arguments: dict[str, type]
    optional: tuple[str, ...] = ()

    def schema(self) -> dict:
        """The tool as a JSON schema of a function."""
        wanted = [a for a in self.arguments if a not in self.optional]
        shape = {"type": "object", "properties": {a: {"type": JSON_TYPES[t]} for a, t in self.arguments.items()}, "required": wanted}
        return {"name": self.name, "description": self.description, "parameters": shape}


class Tools:
    """A registry. Frames are answered with ``most`` rows at most and a mark when there are more."""

    def __init__(self, most: int = 100) -> None:
        self.most, self.known = most, {}

    def add(self, tool: Tool) -> None:
        if tool.name in self.known:
            raise ValueError(f"two tools named {tool.name}")
        self.known[tool.name] = tool

    def schemas(self) -> list[dict]:
        return [t.schema() for t in self.known.values()]

    def _checked(self, tool: Tool, given: dict) -> dict:
        unknown = sorted(set(given) - set(tool.arguments))
        missing = [a for a in tool.arguments if a not in given and a not in tool.optional]
        if unknown or missing:
            raise ValueError(f"unknown arguments {unknown}, missing arguments {missing}")
        out = {}
        for name, value in given.items():
            kind = tool.arguments[name]
            fits = isinstance(value, (int, float)) and not isinstance(value, bool) if kind is float else isinstance(value, kind) and (kind is bool or not isinstance(value, bool))
            if not fits:
                raise ValueError(f"{name} must be a {JSON_TYPES[kind]}")
            out[name] = kind(value)
        return out

    def call(self, name: str, arguments: str | dict) -> str:
        """A JSON object: the result, or ``error``."""
        try:
            if name not in self.known:
                raise ValueError(f"no tool named {name}")
            given = json.loads(arguments or "{}") if isinstance(arguments, str) else arguments
            if not isinstance(given, dict):
                raise ValueError("arguments must be an object")
            result = self.known[name].run(**self._checked(self.known[name], given))
            if isinstance(result, DataFrame):
                rows = result.limit(self.most + 1).select(F.to_json(F.struct("*"))).collect()
                return json.dumps({"rows": [json.loads(r[0]) for r in rows[: self.most]], "more": len(rows) > self.most}, ensure_ascii=False)
            return json.dumps(result, ensure_ascii=False, default=str)
        except Exception as e:  # the caller is a model that reads what went wrong
            return json.dumps({"error": f"{type(e).__name__}: {e}"}, ensure_ascii=False)


def run_steps(state: dict, steps: list[tuple[str, Callable[[dict], dict]]]) -> dict:
    """Steps in a line, each adding to the state; after one that adds ``error`` the rest are
    left out. ``done`` lists the names of the steps that ran."""
    state = {**state, "done": []}
    for name, step in steps:
        if state.get("error"):
            break
        try:
            state |= step(state)
        except Exception as e:  # a failing step is an answer of the pipeline
            state["error"] = f"{name}: {type(e).__name__}: {e}"
        state["done"] = [*state["done"], name]
    return state
