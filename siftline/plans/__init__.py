"""Composed jobs, the derived test views and the registered queries."""
