"""Model interfaces and deterministic stand-ins; real models plug in behind the same methods."""

from __future__ import annotations

import hashlib
import math
import re
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class TextModel(Protocol):
    def complete(self, prompt: str, system: str = "") -> str: ...


class VisionModel(Protocol):
    def read(self, image: bytes, mime: str) -> str: ...


class HashedWords:
    """Unit vectors of hashed word counts."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = [0.0] * self.size
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else None)
        return out


class FixedAnswer:
    """The same answer to every prompt."""

    def __init__(self, answer: str = ""):
        self.answer = answer

    def complete(self, prompt: str, system: str = "") -> str:
        return self.answer


class Unseeing:
    def read(self, image: bytes, mime: str) -> str:
        return ""


class Parallel:
    """A text model that is waited for, such as a server, asked `width` prompts at a time."""

    def __init__(self, model: TextModel, width: int = 8):
        self.model, self.width = model, width

    def complete(self, prompt: str, system: str = "") -> str:
        return self.model.complete(prompt, system)

    def complete_all(self, prompts: list[str], system: str = "") -> list[str]:
        with ThreadPoolExecutor(self.width) as pool:
            return list(pool.map(lambda p: self.model.complete(p, system), prompts))


def complete_all(model: TextModel, prompts: list[str], system: str = "") -> list[str]:
    """The answers to a batch of prompts in order; a model without complete_all is asked one after the other."""
    if not prompts:
        return []
    together = getattr(model, "complete_all", None)
    return together(prompts, system) if together else [model.complete(p, system) for p in prompts]


def accept_rewrite(query: str, answer: str) -> str:
    """A model's rewritten query if it is usable, else the query itself."""
    answer = re.sub(r"(?s)<think>.*?</think>", "", answer).strip()
    return answer if 3 < len(answer) < 200 and not answer.startswith("❌") else query


def accept_description(answer: str) -> str:
    """A vision model's description of five words or more, without its reasoning."""
    answer = re.sub(r"(?is)<think>.*?</think>", "", answer).strip()
    return answer if len(answer.split()) >= 5 else ""
