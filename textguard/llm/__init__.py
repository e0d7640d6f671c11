"""Operators for preparing training data: each module is one operator, ``catalog`` holds their queries."""
