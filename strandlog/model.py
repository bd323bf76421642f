"""Row shapes, options and errors of the log and key-value engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: A log entry: nanoseconds since the epoch, labels, sequence and message; label_key is the labels' canonical text.
LOG_SCHEMA = T.StructType([
    T.StructField("ts_nanos", T.LongType(), False),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType(), False), False),
    T.StructField("label_key", T.StringType(), False),
    T.StructField("sequence", T.LongType(), False),
    T.StructField("message", T.StringType(), False),
])

#: A version of a key. The highest version of a key is the newest; deleted marks a tombstone.
KV_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType()),
    T.StructField("deleted", T.BooleanType(), False),
    T.StructField("version", T.LongType(), False),
])

LOG_ORDER = ("ts_nanos", "label_key", "sequence")

#: Limits of the query surface and the sizes that accounting adds to a record.
DEFAULT_LIMIT, MAX_LIMIT = 1000, 10_000
MAX_BATCH = 10_000
TABLE_RECORD_BYTES, MEMORY_RECORD_BYTES = 13, 24
LOG_KEY_BYTES, LOG_VALUE_BYTES = 17, 14
MAX_NANOS, MIN_NANOS = (1 << 63) - 1, -(1 << 63)


class EngineError(Exception):
    """Of all errors this engine raises by itself."""


class InvalidQuery(EngineError, ValueError):
    """A query text or one of its parts breaks the grammar."""


class InvalidRange(EngineError, ValueError):
    """Start is not before end of a key range."""


class InvalidTimeRange(EngineError, ValueError):
    """End is before start of a time range."""


class InvalidLabel(EngineError, ValueError):
    """A label name is empty, or a name or value holds NUL."""


class DuplicateLabel(InvalidLabel):
    """A label name stands twice."""


class InvalidEntry(EngineError, ValueError):
    """A log entry or batch breaks the ingest rules; the whole batch is refused."""


class InvalidOptions(EngineError, ValueError):
    """An option is out of its range."""


class CorruptStore(EngineError):
    """A manifest, file or backup doesn't hold what it should."""


class Conflict(EngineError):
    """Another writer published a generation meanwhile."""


def status_of(error: Exception) -> int:
    """The HTTP status that an embedding service answers an error with."""
    if isinstance(error, Conflict):
        return 409
    if isinstance(error, CorruptStore):
        return 503
    return 400 if isinstance(error, (EngineError, ValueError)) else 500


@dataclass(frozen=True)
class Options:
    """Engine options; sizes in bytes, retention in nanoseconds, 0 turns a limit off; 0 workers are as many as the cluster has cores."""

    checkpoint_bytes: int = 4 << 20
    auto_checkpoint: bool = True
    compaction_threshold: int = 4
    compaction_workers: int = 0
    compaction_task_bytes: int = 8 << 20
    max_levels: int = 4
    level_base_bytes: int = 64 << 20
    level_multiplier: int = 10
    retention_nanos: int = 0
    max_size_bytes: int = 0
    compression: str = "snappy"
    keep_generations: int = 2
    promoted_labels: tuple[str, ...] = ()

    def __post_init__(self):
        checks = (
            (self.checkpoint_bytes > 0, "checkpoint_bytes must be positive"),
            (self.compaction_threshold >= 0, "compaction_threshold can't be negative"),
            (self.compaction_workers >= 0, "compaction_workers can't be negative"),
            (self.compaction_task_bytes > 0, "compaction_task_bytes must be positive"),
            (self.max_levels >= 2, "max_levels must be 2 or more"),
            (self.level_base_bytes > 0, "level_base_bytes must be positive"),
            (self.level_multiplier >= 2, "level_multiplier must be 2 or more"),
            (self.retention_nanos >= 0, "retention can't be negative"),
            (self.max_size_bytes >= 0, "max_size_bytes can't be negative"),
            (self.keep_generations >= 1, "keep_generations must be positive"),
        )
        for ok, why in checks:
            if not ok:
                raise InvalidOptions(why)
        object.__setattr__(self, "compression", codec_name(self.compression))

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "STRANDLOG_") -> Options:
        """Options from variables; a text that isn't a number falls back to the default, a number out of range is an error."""
        kwargs: dict = {}
        for name, field in cls.__dataclass_fields__.items():
            text = env.get(prefix + name.upper())
            if text is None:
                continue
            if name == "promoted_labels":
                kwargs[name] = tuple(x for x in text.split(",") if x)
            elif field.type == "bool":
                if text.lower() in ("1", "t", "true", "0", "f", "false"):
                    kwargs[name] = text.lower() in ("1", "t", "true")
            elif field.type == "int":
                try:
                    kwargs[name] = int(text)
                except ValueError:
                    continue
            else:
                kwargs[name] = text
        return cls(**kwargs)


#: Codec names and their stable ids.
CODECS = {"none": 0, "gzip": 1, "snappy": 2, "lz4": 3, "zstd": 4}


def codec_name(name: str) -> str:
    """Trimmed and lower-cased, as one of CODECS."""
    clean = name.strip().lower()
    if clean not in CODECS:
        raise InvalidOptions(f"unknown compression {name!r}")
    return clean
