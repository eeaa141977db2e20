"""External models behind small protocols, with deterministic stand-ins that run offline."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from typing import Protocol

from folioscope.functions.folds import hashed_embedding, parse_answer


class Embedder(Protocol):
    def __call__(self, text: str) -> list[float]: ...


class Extractor(Protocol):
    def __call__(self, text: str, labels: Iterable[str]) -> list[tuple[str, str, str]]: ...


def embed(text: str, dim: int = 64) -> list[float]:
    return hashed_embedding(text, dim)


def extract_cooccurrences(text: str, labels: Iterable[str]) -> list[tuple[str, str, str]]:
    """(source, target, type): labels that one sentence names are related, in order of their places."""
    out = []
    known = list(labels)
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        low = sentence.lower()
        found = sorted({(low.find(x.lower()), x) for x in known if x and x.lower() in low})
        out += [(a, b, "BEZOGEN_AUF") for (_, a), (_, b) in zip(found, found[1:], strict=False)]
    return list(dict.fromkeys(out))


def with_retries(call: Callable[[str], str], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, str]]:
    """A model call with growing pauses; its answer is parsed as JSON, (None, reason) if all tries fail."""

    def run(prompt: str) -> tuple[str | None, str]:
        reason = ""
        for number in range(tries):
            try:
                parsed, reason = parse_answer(call(prompt))
            except Exception as error:  # noqa: BLE001 - any failure of an external service is retried
                parsed, reason = None, type(error).__name__
            if parsed is not None:
                return parsed, ""
            if number + 1 < tries:
                sleep(wait * 2**number)
        return None, reason

    return run
