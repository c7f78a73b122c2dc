"""Training-data operators: ten text operators, their queries and their SQL.

Nothing outside this subpackage imports it.
"""
