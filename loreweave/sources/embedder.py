"""Vectors from a service on the network."""

from __future__ import annotations

import json
import os
import urllib.request
from dataclasses import dataclass


@dataclass(frozen=True)
class HttpEmbedder:
    """Asks a service with the widespread embeddings interface: POST of model and input to URL/embeddings, answered by a
    list ``data`` of index and embedding.

    The key is read from an environment variable where the call is made, on executors too; without one, none is sent.
    Errors are raised; callers try again.
    """

    url: str
    model: str
    key_variable: str = "EMBEDDING_API_KEY"
    timeout: float = 60.0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        key = os.environ.get(self.key_variable)
        heads = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        body = json.dumps({"model": self.model, "input": texts}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{self.url.rstrip('/')}/embeddings", body, heads), timeout=self.timeout) as answer:
            data = json.load(answer)["data"]
        if sorted(d["index"] for d in data) != list(range(len(texts))):
            raise ValueError(f"Asked for {len(texts)} vectors, the answer has {len(data)}")
        return [[float(x) for x in d["embedding"]] for d in sorted(data, key=lambda d: d["index"])]
