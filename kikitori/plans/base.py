"""Registering queries together with their SQL."""

from __future__ import annotations


class Book:
    """Queries of one module: name to callable, name to SQL."""

    def __init__(self):
        self.found, self.sql = {}, {}

    def query(self, name: str, sql: str | None = None):
        def keep(f):
            self.found[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep

    def queries(self):
        return dict(self.found)

    def oracle_sql(self):
        return dict(self.sql)
