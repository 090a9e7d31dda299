"""Models behind roles, and the shape that any provider of them has. Without a provider every role is unavailable, which all callers allow for."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..streaming.ingest import Cooldown

ROLES = ("fast", "answer", "vision", "judge")


class ProviderDown(RuntimeError):
    """The provider of a model does not answer now: the model rests, and the next is asked."""


class NoModel(RuntimeError):
    """No model of a role's chain gave an answer."""


@runtime_checkable
class Provider(Protocol):
    """Asks a model for text. Raises :class:`ProviderDown` if it can't now."""

    def has_key(self, model: str) -> bool: ...

    def complete(self, model: str, prompt: str) -> str: ...


@runtime_checkable
class Embedder(Protocol):
    dim: int

    def embed_docs(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class Router:
    """Chains of models by role over one provider. Sent to the workers whole; each worker keeps its own rests."""

    def __init__(self, chains: dict[str, str], provider: Provider | None = None, seconds: float = 60.0):
        unknown = set(chains) - set(ROLES)
        if unknown:
            raise ValueError(f"no such roles: {sorted(unknown)}")
        self.chains = {r: [m.strip() for m in chains.get(r, "").split(",") if m.strip()] for r in ROLES}
        self.provider, self.cooldown = provider, Cooldown(seconds)

    def usable(self, role: str) -> list[str]:
        return [m for m in self.chains[role] if self.provider is not None and self.provider.has_key(m)]

    def available(self, role: str) -> bool:
        return bool(self.usable(role))

    def label(self, role: str) -> str:
        return next(iter(self.usable(role)), "offline")

    def complete(self, role: str, prompt: str) -> str:
        """The first answer of the chain that is not empty. An empty one passes on to the next model, which does not rest for it."""
        why = []
        for model in self.chains[role]:
            if self.provider is None or not self.provider.has_key(model):
                why.append(f"{model}: no key")
            elif not self.cooldown.ready(model):
                why.append(f"{model}: resting")
            else:
                try:
                    if text := (self.provider.complete(model, prompt) or "").strip():
                        return text
                    why.append(f"{model}: empty")
                except ProviderDown as e:
                    self.cooldown.rest(model)
                    why.append(f"{model}: {e}")
        raise NoModel(f"{role}: " + ("; ".join(why) or "no models"))

    def column(self, role: str, prompt: Column | str) -> Column:
        """Answers to a column of prompts, in batches; null where the prompt is null or no model answers."""

        @F.pandas_udf("string")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def one(p: str | None) -> str | None:
                try:
                    return None if p is None else self.complete(role, p)
                except NoModel:
                    return None

            for s in parts:
                yield s.map(one, na_action=None)

        return run(prompt)
