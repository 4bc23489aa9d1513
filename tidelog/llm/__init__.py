"""Operators for preparing training data: one module per operator, plus their registered queries.

Nothing outside this folder imports it; ``registry`` lists the queries and their SQL.
"""
