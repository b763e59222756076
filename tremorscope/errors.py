"""What the engine raises on the driver."""


class EngineError(Exception):
    """Any of the following."""


class SchemaMixError(EngineError, ValueError):
    """Records of another schema version than the engine's."""


class DuplicateScoreError(EngineError, ValueError):
    """One call key with conflicting scores."""


class OverlappingRepeatsError(EngineError, ValueError):
    """Screening and estimation repeats overlap."""


class UnknownEnvironmentError(EngineError, KeyError):
    """A named environment has no records."""


class UnknownPriceError(EngineError, KeyError):
    """A model without a declared price."""


class CorruptShardError(EngineError, ValueError):
    """A broken line inside a shard."""


class AnalysisError(EngineError, ValueError):
    """An analysis that can't be made as asked."""


class GateError(EngineError, RuntimeError):
    """A run that its gates do not let through."""
