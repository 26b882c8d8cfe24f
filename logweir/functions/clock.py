"""Instants, milliseconds and day keys, in UTC whatever the session's time zone is."""


def to_millis(ts: str) -> str:
    """Cut to whole milliseconds, the precision of the stored tables."""
    return f"date_trunc('millisecond', {ts})"


def day_key(ts: str) -> str:
    """The UTC day of an instant."""
    return f"date_from_unix_date(cast(floor(unix_seconds({ts}) / 86400) AS int))"


def rfc3339(ts: str) -> str:
    """UTC text such as ``2024-01-01T00:00:07.179Z``; whole seconds carry no fraction."""
    since_epoch = f"make_dt_interval(0, 0, 0, unix_seconds({ts}))"
    seconds = f"replace(string(TIMESTAMP_NTZ'1970-01-01 00:00:00' + {since_epoch}), ' ', 'T')"
    millis = f"pmod(unix_millis({ts}), 1000)"
    return f"concat({seconds}, if({millis} = 0, '', concat('.', lpad({millis}, 3, '0'))), 'Z')"


# The time that container runtimes put before a line and its first space.
_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"


def _first_word(line: str) -> str:
    return f"substring_index({line}, ' ', 1)"


def is_timed(line: str) -> str:
    """Whether a line starts with its time and a space."""
    return f"(contains({line}, ' ') AND {_first_word(line)} RLIKE r'{_TIME}')"


def line_time(line: str, timed: str | None = None) -> str:
    """The event time a line starts with, or null; ``timed`` is what :func:`is_timed` said of it."""
    return f"CASE WHEN {timed or is_timed(line)} THEN try_to_timestamp({_first_word(line)}) END"


def line_text(line: str, timed: str | None = None) -> str:
    """The line without its time prefix."""
    rest = f"substring({line}, length({_first_word(line)}) + 2)"
    return f"CASE WHEN {timed or is_timed(line)} THEN {rest} ELSE {line} END"


def instant(text: str) -> str:
    """The instant that a text names, or null: a time with zone, or seconds or milliseconds since 1970."""
    number = f"CAST({text} AS decimal(24, 9))"
    return (
        f"CASE WHEN {text} RLIKE r'{_TIME}' THEN try_to_timestamp({text}) "
        rf"WHEN {text} RLIKE r'^\d{{1,14}}(\.\d{{1,20}})?(E\d)?$|^\d\.\d{{1,20}}E1[0-3]$' THEN timestamp_micros(bigint("
        f"CASE WHEN {number} < 100000000000 THEN floor({number} * 1000000) "
        f"WHEN {number} < 100000000000000 THEN floor({number} * 1000) END)) END"
    )
