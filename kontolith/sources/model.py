"""A language model behind a chat endpoint as the source of categories."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass

from kontolith import schemas as S

#: What the model is told; the categories are the ledger's.
TASK = (
    "Ordne jeden nummerierten Verwendungszweck genau einer Kategorie zu: " + ", ".join(S.CATEGORIES[:-1]) + '. Antworte nur mit JSON der Form {"ergebnis": [{"i": 0, "kategorie": "..."}]}.'
)
PROBE_SECONDS = 5


@dataclass(frozen=True)
class ModelClient:
    """Call it with a batch of purposes; it returns their categories by number. It can be sent to executors."""

    url: str
    name: str
    timeout: int = 180

    def _open(self, path: str, body: dict | None, timeout: int):
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url.rstrip("/") + path, data, {"Content-Type": "application/json"})  # noqa: S310 - the address is the user's setting
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return json.load(answer)

    def reachable(self) -> bool:
        try:
            self._open("/v1/models", None, PROBE_SECONDS)
            return True
        except (OSError, ValueError):
            return False

    def __call__(self, texts: list[str]) -> dict[int, str]:
        listed = "\n".join(f"{i}: {t}" for i, t in enumerate(texts))
        body = {"model": self.name, "temperature": 0, "stream": False, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": TASK}, {"role": "user", "content": listed}]}
        return categories_of(self._open("/v1/chat/completions", body, self.timeout)["choices"][0]["message"]["content"])


def categories_of(answer: str) -> dict[int, str]:
    """Categories by number of an answer, a list or an object with ``ergebnis``; what is outside the set is left out."""
    data = json.loads(answer)
    rows = data.get("ergebnis", []) if isinstance(data, dict) else data
    known = {c.lower(): c for c in S.CATEGORIES[:-1]}
    out = {}
    for row in rows if isinstance(rows, list) else []:
        if not isinstance(row, dict):
            continue
        i, name = row.get("i", row.get("index")), known.get(str(row.get("kategorie", "")).lower())
        if isinstance(i, int) and name:
            out[i] = name
    return out


def model_of(settings) -> ModelClient | None:
    """The client that the settings name, or None if they turn it off or it doesn't answer."""
    client = ModelClient(settings.model_url, settings.model_name, settings.model_timeout)
    return client if settings.model_enabled and client.reachable() else None
