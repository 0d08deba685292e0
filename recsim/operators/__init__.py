"""DataFrame operators (no Spark actions unless a docstring says otherwise)."""
