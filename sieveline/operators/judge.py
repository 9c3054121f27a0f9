"""A judge for triage: a chat service asked for verdicts, text by text, from where the texts are."""

from __future__ import annotations

import http.client
import json
import os
import re
import time
import urllib.error
import urllib.request

from .triage import DEFAULT_ROUTE, ROUTES

SYSTEM = (
    "You review source code for malware. Weigh all files of the message together and answer with one JSON object that has the keys decision and reasoning. "
    "decision is benign if nothing is harmful, suspicious if something is doubtful, malicious if harm is plain; reasoning is one sentence."
)
#: Answers of a service after which asking again can help.
AGAIN = {408, 409, 425, 429, 500, 502, 503, 504, 529}


def address_of(model: str) -> str:
    """The base address of a model's service, as triage.route_by_keyword has it for columns."""
    return next((url for words, url in ROUTES if re.search("|".join(words), model.lower())), DEFAULT_ROUTE)


class ChatJudge:
    """A callable on lists of texts for triage.decide: one request for each text, one reply (a JSON object) for each.

    The key comes from the argument or the driver's LLM_API_KEY, the address from the argument, LLM_BASE_URL or the model's name; both go to the
    workers with the judge. Without a key nothing is sent. What fails for a while is asked again, each time after twice the wait or what the
    service asks for; what fails for good is suspicious, with the reason: no text's failure is another's."""

    def __init__(self, model: str, key: str | None = None, address: str | None = None, retries: int = 3, wait: float = 1.0, longest_wait: float = 60.0, timeout: float = 120.0, system: str = SYSTEM):
        self.model, self.key = model, key or os.environ.get("LLM_API_KEY") or None
        self.address = (address or os.environ.get("LLM_BASE_URL") or address_of(model)).rstrip("/")
        self.retries, self.wait, self.longest_wait, self.timeout, self.system = retries, wait, longest_wait, timeout, system

    def __repr__(self) -> str:
        return f"ChatJudge({self.model!r}, address={self.address!r})"

    def __call__(self, texts: list[str]) -> list[str]:
        return [self.reply(t) for t in texts]

    def reply(self, text: str) -> str:
        if not self.key:
            return _doubt("no key was given")
        try:
            answer = json.loads(self._sent(text))
            return answer["choices"][0]["message"]["content"] or _doubt("the answer is empty")
        except (LookupError, TypeError, ValueError):
            return _doubt("the answer isn't one of a chat service")
        except (OSError, http.client.HTTPException) as error:
            return _doubt(f"the service failed: {error}")

    def _sent(self, text: str) -> bytes:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": f"The files:\n\n{text}"}]
        body = json.dumps({"model": self.model, "messages": messages, "response_format": {"type": "json_object"}}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        pause = self.wait
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.address}/chat/completions", body, head), timeout=self.timeout) as response:
                    return response.read()
            except urllib.error.HTTPError as error:
                if not left or error.code not in AGAIN:
                    raise
                asked = error.headers.get("Retry-After") or ""
                time.sleep(min(max(pause, float(asked) if asked.isdigit() else 0), self.longest_wait))
            except (OSError, http.client.HTTPException):
                if not left:
                    raise
                time.sleep(min(pause, self.longest_wait))
            pause *= 2
        raise AssertionError


def _doubt(reason: str) -> str:
    return json.dumps({"decision": "suspicious", "reasoning": reason})
