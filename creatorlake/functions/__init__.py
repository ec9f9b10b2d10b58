"""Scalar semantics as SQL expressions.

Each function takes SQL text (a column name or an expression) and gives SQL text for ``F.expr`` or
``selectExpr``. Everything stays inside the JVM, and one parsed expression costs the driver far less
than the hundreds of Column objects it stands for.
"""
