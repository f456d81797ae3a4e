"""Chat models over HTTP, behind the one function that the operators call; used on the driver alone."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from .lines import Settings

#: Answers of a server that another try may change.
AGAIN = {408, 409, 429, 500, 502, 503, 504}


@dataclass(frozen=True)
class Reply:
    content: str
    tokens: int | None = None


@dataclass
class Client:
    """One model of a server that speaks the common chat completion protocol. A call that fails for a passing reason is tried again, at most max_retries times, after growing pauses."""

    base_url: str
    api_key: str
    model: str
    timeout_seconds: float = 60.0
    max_retries: int = 2
    reasoning_effort: str = ""
    temperature: float = 0.0
    max_tokens: int = 8192
    pause: Callable[[float], None] = field(default=time.sleep, repr=False)

    def __post_init__(self):
        if not self.api_key:
            raise ValueError("a chat client needs a key")
        if not self.base_url:
            raise ValueError("a chat client needs an address")
        self.timeout_seconds, self.max_retries = max(1.0, float(self.timeout_seconds)), max(0, int(self.max_retries))

    def __call__(self, messages: list[dict]) -> Reply:
        body = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_completion_tokens": self.max_tokens}
        if self.reasoning_effort:
            body["reasoning_effort"] = self.reasoning_effort
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        for left in range(self.max_retries, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout_seconds) as answer:
                    return _reply(json.load(answer))
            except urllib.error.HTTPError as why:
                if why.code not in AGAIN or not left:
                    raise
            except OSError:  # unreachable, or too slow
                if not left:
                    raise
            self.pause(0.5 * 2 ** (self.max_retries - left))
        raise AssertionError("no try")


def _reply(answer: dict) -> Reply:
    choices = answer.get("choices") or [{}]
    tokens = (answer.get("usage") or {}).get("total_tokens")
    return Reply(((choices[0].get("message") or {}).get("content") or "").strip(), int(tokens) if tokens else None)


def clients(settings: Settings, api_key: str) -> tuple[Client, list[Client]]:
    """The primary model's client, and those of the fallback models, none where they are disabled."""
    of = lambda model: Client(settings.base_url, api_key, model, settings.request_timeout_seconds, settings.max_retries)
    return of(settings.primary_model), [] if settings.disable_fallback else [of(m) for m in settings.fallback_models]
