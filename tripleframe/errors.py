"""Errors that callers match on."""


class EngineError(Exception):
    pass


class InvalidTripleError(EngineError):
    pass


class InvalidTermError(EngineError):
    def __init__(self, term: str, reason: str):
        super().__init__(f"invalid term {term!r}: {reason}")
        self.term, self.reason = term, reason


class PredicateLimitExceededError(EngineError):
    pass
