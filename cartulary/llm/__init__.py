"""Training-data operators: one module per operator, one ``query_`` adapter each.

Nothing outside this package imports it.  Every operator takes a DataFrame
plus column names, selects only the columns it needs (so extra columns with
clashing names are harmless) and keeps to these conventions unless its own
docstring says otherwise: a null text is the empty text, repeated input rows
give repeated output rows, an empty table gives an empty result.
"""
