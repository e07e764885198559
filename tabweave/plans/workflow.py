"""Saved runs: versioned documents with an identity hash, their migration, and a bounded history."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from ..sources.sinks import write_json
from .config import Config

FORMAT, VERSION, KEPT = "tabweave-workflow", 2, 50


class WorkflowError(ValueError):
    """A document that was changed by hand, or comes from a later version."""


def _identity(operations: list[dict]) -> str:
    return hashlib.sha256(json.dumps(operations, sort_keys=True, default=str).encode()).hexdigest()


def build(config: Config, inputs: list[str], output: str | None = None, kind: str = "process") -> dict:
    """A document of ordered operations and their identity."""
    default = Config().document()
    changed = {k: v for k, v in config.document().items() if v != default[k]}
    operations = [{"op": "scan", "inputs": list(inputs)}, {"op": kind, "config": changed}, {"op": "write", "output": output}]
    operations = json.loads(json.dumps(operations, default=str))
    return {"format": FORMAT, "version": VERSION, "created": datetime.now(UTC).isoformat(), "operations": operations, "identity": _identity(operations)}


def migrated(document: dict) -> dict:
    """A version 1 document (config, inputs, output at the top) as version 2; later versions are refused."""
    version = document.get("version", 1)
    if version > VERSION:
        raise WorkflowError(f"version {version} is later than {VERSION}")
    if version == VERSION:
        return document
    return build(Config.of(document.get("config") or {}), document.get("inputs") or [], document.get("output"))


def replayed(document: dict) -> tuple[Config, list[str], str | None]:
    """Configuration, inputs and output of a document whose identity holds."""
    document = migrated(document)
    if document.get("format") != FORMAT or _identity(document["operations"]) != document.get("identity"):
        raise WorkflowError("the document's identity doesn't hold")
    by = {o["op"]: o for o in document["operations"]}
    return Config.of(document["operations"][1]["config"]), by["scan"]["inputs"], by["write"]["output"]


def save(path: str, document: dict) -> str:
    return write_json(path, document)


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def remembered(history: dict | None, document: dict, kept: int = KEPT) -> dict:
    """The history with the document first, each identity once, at most `kept` of them."""
    old = [d for d in (history or {}).get("runs", []) if d["identity"] != document["identity"]]
    return {"format": f"{FORMAT}-history", "version": VERSION, "runs": [document, *old][:kept]}


class Undo:
    """Configurations to go back to and forth between."""

    def __init__(self, config: Config, kept: int = KEPT):
        self.past, self.future, self.kept = [config], [], kept

    def push(self, config: Config) -> None:
        if config != self.past[-1]:
            self.past, self.future = [*self.past, config][-self.kept :], []

    def undo(self) -> Config:
        if len(self.past) > 1:
            self.future.append(self.past.pop())
        return self.past[-1]

    def redo(self) -> Config:
        if self.future:
            self.past.append(self.future.pop())
        return self.past[-1]
