"""Operations of a training-data pipeline on a ``documents`` table.

Nothing outside this package imports it.  ``queries.py`` maps the registered names to functions, ``oracle.py`` holds the
DuckDB texts.
"""
