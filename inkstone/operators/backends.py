"""A registry of extraction backends: (backend, primitive) to a function of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import enrich, extract

_REGISTRY: dict[tuple[str, str], Callable[..., DataFrame]] = {}
_DEFAULT = ["regex"]
#: Names that ``auto`` tries in turn.
PREFERRED = ("spacy", "regex")


def register(backend: str, primitive: str, run: Callable[..., DataFrame]) -> None:
    _REGISTRY[backend, primitive] = run


def resolve(backend: str | None, primitive: str) -> Callable[..., DataFrame]:
    """The function of a backend; ``auto`` takes the first that has one, None the default."""
    backend = backend or _DEFAULT[0]
    for name in PREFERRED if backend == "auto" else (backend,):
        if (name, primitive) in _REGISTRY:
            return _REGISTRY[name, primitive]
    if primitive in SLOTS.get(backend, ("", ()))[1]:
        return enrich.missing_backend(backend, SLOTS[backend][0])
    raise ImportError(f"no backend {backend!r} for {primitive!r}; known: {sorted({b for b, p in _REGISTRY if p == primitive})}")


def set_default(backend: str) -> None:
    if backend != "auto" and backend not in {*SLOTS, *(b for b, _ in _REGISTRY)}:
        raise ImportError(f"no backend {backend!r}")
    _DEFAULT[0] = backend


for _name in ("metadata", "phrases", "correlate_facts", "toc", "outline", "stats"):
    register("regex", _name, getattr(extract, _name))
register("rules", "entities", enrich.entities)
register("rules", "metadata", lambda docs, **how: extract.metadata(docs, entities=True, **how))

#: Backends that need packages and models which this library does not bring, and
#: what they would do; ``register`` fills a slot, and until then using it says what is missing.
SLOTS = {
    "spacy": ("spaCy and a language model", ("entities", "metadata", "phrases", "correlate_facts")),
    "yake": ("YAKE", ("phrases",)),
}
