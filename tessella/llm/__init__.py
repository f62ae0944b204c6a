"""Training-data operators: one module per operator, queries and oracle SQL in ``queries`` and ``oracles``.

Nothing else in the library imports this subpackage.
"""
