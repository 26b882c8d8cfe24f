"""Log level and output stream, from stored text and from message text."""

from logweir.functions.patterns import matches
from logweir.functions.text import contains_any, first_case

# Level names and the spellings read as each of them.
LEVEL_SPELLINGS = {
    "DEBUG": ["DEBUG"],
    "INFO": ["INFO"],
    "WARN": ["WARN", "WARNING"],
    "ERROR": ["ERROR", "ERR"],
    "FATAL": ["FATAL", "CRITICAL"],
}
UNKNOWN_LEVEL = "UNKNOWN"

# Substrings that set the level of a line as it arrives, first hit first.
INGEST_WORDS = {
    "ERROR": ["ERROR", "FATAL", "CRITICAL"],
    "WARN": ["WARN"],
    "DEBUG": ["DEBUG", "TRACE"],
}
INGEST_DEFAULT = "INFO"
STDERR_PREFIX = "stderr"


def normalize_level(level: str) -> str:
    spelled = {
        f"upper({level}) IN ({', '.join(repr(s) for s in spellings)})": name
        for name, spellings in LEVEL_SPELLINGS.items()
    }
    return first_case(spelled, UNKNOWN_LEVEL)


def normalize_source(source: str) -> str:
    return first_case({f"upper({source}) = 'STDERR'": "STDERR"}, "STDOUT")


def ingest_level(message: str) -> str:
    """Level by plain substring, any case: ``terror`` counts as an error."""
    found = {
        contains_any(f"upper({message})", words): level for level, words in INGEST_WORDS.items()
    }
    return first_case(found, INGEST_DEFAULT)


def ingest_source(message: str) -> str:
    return first_case({f"startswith({message}, '{STDERR_PREFIX}')": "STDERR"}, "STDOUT")


def extract_level(message: str) -> str:
    """Level by whole words. Outer whitespace cannot change the result, so none is cut."""
    found = {
        matches(message, "error"): "ERROR",
        matches(message, "warning"): "WARN",
        matches(message, "debug"): "DEBUG",
        matches(message, "stack_start"): "ERROR",
    }
    return first_case(found, "INFO")


def display_level(level: str) -> str:
    """The mixed-case name used in JSON and CSV: ``Error``, ``Unknown``."""
    return f"initcap({level})"
