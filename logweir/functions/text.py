"""Text helpers."""

# Leading or trailing whitespace in the Unicode sense. The lookbehind starts the second
# branch only at the head of a run, so long inner runs stay linear.
_OUTER_SPACE = r"(?U)^\s+|(?<!\s)\s+\z"


def trim_unicode(text: str) -> str:
    """Cut outer whitespace. Only text that begins or ends with some goes to the regex."""
    ends = f"concat(left({text}, 1), right({text}, 1))"
    cut = f"regexp_replace({text}, r'{_OUTER_SPACE}', '')"
    return f"CASE WHEN {ends} RLIKE r'(?U)\\s' THEN {cut} ELSE {text} END"


def fold_case(text: str) -> str:
    """Lower case, with the long s taken for the s that case-blind regexes read it as.

    Upper-casing first would fold it too, but Catalyst drops the inner of two conversions.
    """
    return f"replace(lower({text}), '\u017f', 's')"


def contains_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{word}')" for word in words) + ")"


def first_case(cases: dict[str, str], default: str) -> str:
    """The value of the first condition that holds, else ``default``."""
    whens = " ".join(f"WHEN {condition} THEN '{value}'" for condition, value in cases.items())
    return f"CASE {whens} ELSE '{default}' END"


def format_count(n: str) -> str:
    """``1.2M``, ``3.4K`` or the plain number, half away from zero as browsers round.

    ``format_number`` rounds exact halves to even. A half is exact only at a quarter of the
    unit, where a hundredth is added first.
    """

    def scaled(unit: int) -> str:
        nudge = f"CASE WHEN {n} % {unit // 2} = {unit // 4} THEN 0.01D ELSE 0D END"
        return f"format_number({n} / {unit}D + {nudge}, '0.0')"

    return (
        f"CASE WHEN {n} >= 1000000 THEN concat({scaled(1_000_000)}, 'M') "
        f"WHEN {n} >= 1000 THEN concat({scaled(1_000)}, 'K') ELSE string({n}) END"
    )
