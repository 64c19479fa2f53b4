"""Models behind an HTTP interface of chat completions and embeddings, and models by name.

Backends are small values that travel to tasks; keys are read from the environment where the call
is made, so that no key is in a plan, a cache key or a manifest."""

from __future__ import annotations

import importlib
import json
import os
import urllib.request
from dataclasses import dataclass
from typing import Any

from .systems import Reply


def _post(url: str, key_env: str, body: dict[str, Any], timeout: float) -> dict[str, Any]:
    headers = {"Content-Type": "application/json"}
    if key := os.environ.get(key_env, ""):
        headers["Authorization"] = f"Bearer {key}"
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
        return json.loads(r.read())


@dataclass(frozen=True)
class ChatModel:
    """A function from a prompt to a Reply with its usage. json_mode asks for a JSON object."""

    model: str
    base_url: str
    system: str | None = None
    max_tokens: int = 8192
    json_mode: bool = False
    key_env: str = "OPENAI_API_KEY"
    timeout: float = 120.0

    def __call__(self, prompt: str) -> Reply:
        said = [{"role": "system", "content": self.system}] if self.system else []
        body: dict[str, Any] = {"model": self.model, "temperature": 0, "max_tokens": self.max_tokens, "messages": [*said, {"role": "user", "content": prompt}]}
        if self.json_mode:
            body["response_format"] = {"type": "json_object"}
        got = _post(f"{self.base_url.rstrip('/')}/chat/completions", self.key_env, body, self.timeout)
        use = got.get("usage") or {}
        return Reply(got["choices"][0]["message"].get("content") or "", *(int(use.get(k) or 0) for k in ("prompt_tokens", "completion_tokens", "total_tokens")))

    def many(self, prompts: list[str]) -> list[str]:
        return [self(p).text for p in prompts]


@dataclass(frozen=True)
class EmbeddingModel:
    """A function from texts to their vectors, in requests of `batch` texts."""

    model: str
    base_url: str
    batch: int = 64
    key_env: str = "OPENAI_API_KEY"
    timeout: float = 120.0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            got = _post(f"{self.base_url.rstrip('/')}/embeddings", self.key_env, {"model": self.model, "input": texts[at : at + self.batch]}, self.timeout)
            out += [x["embedding"] for x in sorted(got["data"], key=lambda x: x["index"])]
        return out


def made(options: dict[str, Any] | str, kind: type) -> Any:
    """A backend from a spec: options of `kind`, or "module:name" of any function."""
    if isinstance(options, str):
        module, _, name = options.partition(":")
        return getattr(importlib.import_module(module), name)
    return kind(**options)
