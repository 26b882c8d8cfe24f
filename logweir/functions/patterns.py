"""Error patterns in message text."""

from dataclasses import dataclass

from logweir.functions.text import contains_any, fold_case

# The patterns. The flags give Java the Unicode reading of \w \s \d \b and of
# case; \z is the end of the text proper, where $ would also accept a final newline.
REGEXES = {
    "error": r"(?iU)\b(error|err|fatal|critical|exception)\b",
    "warning": r"(?iU)\b(warn|warning)\b",
    "debug": r"(?iU)\b(debug|trace|verbose)\b",
    "stack_frame": r"(?dU)^\s+at\s+[\w.]+\(.*\)\z",
    "stack_start": r"(?iU)(exception|traceback|stack\s*trace)",
    "http_error": r"(?U)HTTP/[\d.]+\s+([45]\d{2})",
    "sql_error": r"(?iU)(sql\s*error|database\s*error|deadlock|timeout)",
    "json_error": r"(?iU)(json\.parse|invalid\s*json|unexpected\s*token)",
}

# Text that every match of a case-blind pattern holds, once folded. A byte search for it is
# several times cheaper than the regex and spares most lines the regex.
_NEEDS = {
    "error": ["err", "fatal", "critical", "exception"],
    "warning": ["warn"],
    "debug": ["debug", "trace", "verbose"],
    "stack_start": ["exception", "traceback", "stack"],
    "sql_error": ["sql", "database", "deadlock", "timeout"],
    "json_error": ["json", "unexpected"],
}


def matches(message: str, name: str) -> str:
    """Whether the named pattern occurs anywhere in ``message``."""
    if name == "stack_frame":
        gate = f"endswith({message}, ')')"
    elif name == "http_error":
        gate = f"contains({message}, 'HTTP/')"
    else:
        gate = contains_any(fold_case(message), _NEEDS[name])
    return f"({gate} AND {message} RLIKE r'{REGEXES[name]}')"


def is_stack_trace(message: str) -> str:
    return f"({matches(message, 'stack_start')} OR {matches(message, 'stack_frame')})"


# Tags in the order they are listed, with the pattern behind each.
TAGS = {
    "error": "error",
    "warning": "warning",
    "stack_trace": "stack_start",
    "http_error": "http_error",
    "sql_error": "sql_error",
    "json_error": "json_error",
}

# The type name of each tag; any other tag is Custom(tag).
TAG_TYPES = {
    "stack_trace": "StackTrace",
    "http_error": "HttpError",
    "sql_error": "SqlError",
    "json_error": "JsonError",
}


def _names_of(conditions: dict[str, str]) -> str:
    """The names whose condition holds, in order.

    Joined from one-entry arrays, as ``array_compact`` would take the conditions out of
    generated code.
    """
    entries = ", ".join(
        f"CASE WHEN {test} THEN array('{name}') ELSE array() END"
        for name, test in conditions.items()
    )
    return f"concat({entries})"


def pattern_tags(message: str) -> str:
    return _names_of({tag: matches(message, pattern) for tag, pattern in TAGS.items()})


def pattern_types(message: str) -> str:
    return _names_of(
        {
            "StackTrace": is_stack_trace(message),
            "HttpError": matches(message, "http_error"),
            "SqlError": matches(message, "sql_error"),
            "JsonError": matches(message, "json_error"),
        }
    )


def tag_type(tag: str) -> str:
    named = " ".join(f"WHEN '{t}' THEN '{kind}'" for t, kind in TAG_TYPES.items())
    return f"CASE {tag} {named} ELSE concat('Custom(', {tag}, ')') END"


@dataclass(frozen=True)
class FilterKind:
    """A filter worth suggesting when its condition occurs."""

    name: str
    query: str
    filter_type: str


# Suggested filters in build order, which also breaks ties.
FILTER_KINDS = {
    "errors": FilterKind("Errors", "level=ERROR", "Level"),
    "warnings": FilterKind("Warnings", "level=WARN", "Level"),
    "stack_traces": FilterKind("Stack Traces", "pattern=stack_trace", "Pattern"),
    "http_errors": FilterKind("HTTP Errors", "pattern=http_error", "Pattern"),
    "database_errors": FilterKind("Database Errors", "pattern=sql_error", "Pattern"),
}


def filter_conditions(message: str) -> dict[str, str]:
    """The condition that each suggested filter counts."""
    return {
        "errors": f"({matches(message, 'error')} OR {matches(message, 'stack_start')})",
        "warnings": matches(message, "warning"),
        "stack_traces": is_stack_trace(message),
        "http_errors": matches(message, "http_error"),
        "database_errors": matches(message, "sql_error"),
    }
