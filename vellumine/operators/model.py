"""A language model behind an HTTP interface, as a callable for ``editor.edit``. Off unless given; no test calls out."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

SYSTEM = "You clean and normalise document elements and answer with the text alone."


@dataclass(frozen=True)
class ModelSettings:
    model: str
    api_key: str
    base_url: str = "https://api.openai.com/v1"
    provider: str = "openai"
    temperature: float = 0.0
    max_output_tokens: int | None = None
    timeout: float = 60.0
    system_prompt: str = SYSTEM


def endpoint(base_url: str) -> str:
    """The chat endpoint of a base address, whether or not it is named there."""
    base = base_url.strip().rstrip("/")
    return base if base.endswith("/chat/completions") else base + "/chat/completions"


def request(settings: ModelSettings, prompt: str, max_tokens: int | None = None) -> dict:
    most = max_tokens or settings.max_output_tokens
    body = {"model": settings.model, "messages": [{"role": r, "content": c} for r, c in (("system", settings.system_prompt), ("user", prompt))], "temperature": min(max(float(settings.temperature), 0.0), 1.0)}
    return body | ({"max_tokens": int(most)} if most else {})


def _post(url: str, headers: dict, body: dict, timeout: float) -> dict:
    sent = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(sent, timeout=timeout) as answer:
        return json.loads(answer.read())


def caller(settings: ModelSettings, post: Callable[[str, dict, dict, float], dict] = _post) -> Callable[..., str]:
    """``call(prompt, max_tokens=None)``; any failure is a RuntimeError. ``post`` may be replaced."""
    if settings.provider.strip().lower() != "openai":
        raise ValueError(f"no client for provider {settings.provider!r}")
    headers = {"Authorization": f"Bearer {settings.api_key}", "Content-Type": "application/json"}

    def call(prompt: str, max_tokens: int | None = None) -> str:
        try:
            answer = post(endpoint(settings.base_url), headers, request(settings, prompt, max_tokens), settings.timeout)
            return answer["choices"][0]["message"]["content"].strip()
        except Exception as e:
            raise RuntimeError(f"the model did not answer: {e}") from e

    return call
