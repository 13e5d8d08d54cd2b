"""Exceptions and warnings of the engine."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class EmptyVocabulary(EngineError, ValueError):
    """No feature survived the vocabulary's bounds."""


class DuplicateId(EngineError, ValueError):
    """An identifier that must be unique occurs twice."""


class RankOutOfRange(EngineError, ValueError):
    """k is below 1, or above the number of candidates in strict mode."""


class EmptyCorpus(EngineError, ValueError):
    """A corpus without documents."""


class BadConfig(EngineError, ValueError):
    """An unknown key or an illegal value in a configuration."""


class BadData(EngineError, ValueError):
    """Stored or loaded data that breaks its own rules."""


class NumericEnvironment(EngineError, RuntimeError):
    """Floating point that is not IEEE binary64 with subnormals."""


class TauExceedsRange(UserWarning):
    """The near-tie threshold spans the whole score range."""


class ChainInflation(UserWarning):
    """Chains are much longer than the largest clique."""


def resolve_k(k: int, n: int, strict: bool = False) -> int:
    """``k`` clamped to ``n``; strict mode raises instead of clamping."""
    if k < 1:
        raise RankOutOfRange(f"k must be at least 1, got {k}")
    if k > n and strict:
        raise RankOutOfRange(f"k = {k} exceeds the {n} candidates")
    return min(k, n)


def check_finite(values, what: str = "value"):
    """The values, if every one is a finite number."""
    values = list(values)
    for i, v in enumerate(values):
        if v is None or v != v or v in (float("inf"), float("-inf")):
            raise BadData(f"{what} {i} is not finite: {v!r}")
    return values


def check_non_negative(values, what: str = "value"):
    """The values, if none is below zero."""
    values = check_finite(values, what)
    for i, v in enumerate(values):
        if v < 0:
            raise BadData(f"{what} {i} is negative: {v!r}")
    return values


def check_unique(values, what: str = "id"):
    """The values, if none occurs twice."""
    values = list(values)
    seen = set()
    for v in values:
        if v in seen:
            raise DuplicateId(f"{what} {v!r} occurs twice")
        seen.add(v)
    return values
