"""Training-data pipeline operators.

One module per operator; ``queries`` registers the thin ``opN_<name>`` queries
and their SQL.  Nothing outside this package imports it.
"""
