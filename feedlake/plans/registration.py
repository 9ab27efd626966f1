"""Collects the queries of one family together with their SQL oracles."""

from __future__ import annotations


class Family:
    def __init__(self):
        self.queries = {}
        self.sql = {}

    def register(self, name: str, sql: str | None = None):
        def keep(query):
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return keep
