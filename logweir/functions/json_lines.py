"""Fields of lines that are JSON objects, read by an explicit schema."""

from logweir.functions import levels
from logweir.functions.clock import instant

# Names writers give to a line's parts; of several the first in the list counts.
MESSAGE_KEYS = ["message", "msg", "log"]
LEVEL_KEYS = ["level", "severity", "lvl"]
TIME_KEYS = ["time", "timestamp", "ts", "@timestamp"]
STREAM_KEYS = ["stream"]

JSON, PLAIN, BROKEN = "json", "plain", "broken"

_KEYS = [*MESSAGE_KEYS, *LEVEL_KEYS, *TIME_KEYS, *STREAM_KEYS]
_SCHEMA = ", ".join(f"`{key}` STRING" for key in _KEYS)


def _opens(line: str) -> str:
    return rf"startswith(ltrim(' \t\r\n', {line}), '{{')"


def fields(line: str) -> str:
    """The known fields of a line that is one whole JSON object, as a struct; null for others.

    All are text: a nested value comes as its JSON text. Of a repeated key the last value counts.
    ``_bad`` is not null if the object could not be read.
    """
    # With a second element behind it, an array of the line has two elements if the line is one value.
    one = f"json_array_length(concat('[', {line}, ',0]')) = 2"
    whole = f"{_opens(line)} AND endswith(rtrim(' \\t\\r\\n', {line}), '}}') AND {one}"
    options = "map('columnNameOfCorruptRecord', '_bad', 'allowSingleQuotes', 'false')"
    return f"CASE WHEN {whole} THEN from_json({line}, '{_SCHEMA}, _bad STRING', {options}) END"


def line_format(line: str, parsed: str) -> str:
    """``json`` for one whole JSON object, ``broken`` for what only starts like one, else ``plain``."""
    good = f"{parsed} IS NOT NULL AND {parsed}._bad IS NULL"
    return f"CASE WHEN {good} THEN '{JSON}' WHEN {_opens(line)} THEN '{BROKEN}' ELSE '{PLAIN}' END"


def _first(parsed: str, keys: list[str]) -> str:
    return f"coalesce({', '.join(f'{parsed}.`{key}`' for key in keys)})"


def message(parsed: str) -> str:
    """The message without the line end that a runtime leaves in it, or null."""
    return rf"rtrim('\r\n', {_first(parsed, MESSAGE_KEYS)})"


def level(parsed: str) -> str:
    """The level that the object names, or null if it names none that is known."""
    named = _first(parsed, LEVEL_KEYS)
    known = f"nullif({levels.normalize_level(named)}, '{levels.UNKNOWN_LEVEL}')"
    return f"CASE WHEN upper({named}) = 'TRACE' THEN 'DEBUG' ELSE {known} END"


def time(parsed: str) -> str:
    """The instant that the object names, or null."""
    return instant(_first(parsed, TIME_KEYS))


def source(parsed: str) -> str:
    """The stream that the object names, or null."""
    stream = _first(parsed, STREAM_KEYS)
    return f"CASE WHEN {stream} IS NOT NULL THEN {levels.normalize_source(stream)} END"
