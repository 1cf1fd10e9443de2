"""The tensor query language: lexer, parser and lowering to DataFrames; SQL compatibility; the query catalogue."""
