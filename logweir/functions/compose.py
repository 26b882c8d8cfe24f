"""Service names in compose file text."""

from logweir.functions.text import trim_unicode

# What follows a top-level ``services:`` up to the next line that is not indented.
_SERVICES_BLOCK = r"(?ms)^services:[ \t]*(?:#[^\n]*)?\r?$(.*?)(?=^[^\s#]|\z)"
_SERVICE_KEY = r"^  ([^\s#:][^:]*?)\s*:\s*(?:#.*)?$"


def _distinct_names(names: str) -> str:
    return f"array_distinct(filter({names}, name -> name != ''))"


def services_loose(content: str) -> str:
    """Every line indented by two spaces that holds a colon, cut to its text.

    This takes nested settings such as ``image: nginx`` for services too.
    """
    lines = (
        f"filter(split({content}, '\\n'), line -> startswith(line, '  ') AND contains(line, ':'))"
    )
    return _distinct_names(f"transform({lines}, line -> rtrim(':', {trim_unicode('line')}))")


def services(content: str) -> str:
    """The keys indented by exactly two spaces under ``services:``."""
    lines = f"split(regexp_extract({content}, r'{_SERVICES_BLOCK}', 1), '\\n')"
    return _distinct_names(f"transform({lines}, line -> regexp_extract(line, r'{_SERVICE_KEY}', 1))")
