"""Expression builders.

Each takes SQL text for its inputs, usually a column name, and returns SQL text. The result
serves ``selectExpr``, ``filter``, ``F.expr`` and plain SQL alike, and costs the driver one
parse where a tree of column calls would cost hundreds of calls into the JVM. Only fixed
values are ever put into the text; what callers pass in stays a literal column.
"""
