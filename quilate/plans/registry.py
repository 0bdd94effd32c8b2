"""All queries of the core and their SQL."""

from __future__ import annotations

from quilate.plans import data_problems, reference_queries, reference_sql

QUERIES: dict = {**reference_queries.QUERIES, **data_problems.QUERIES}
SQL: dict = {**reference_sql.SQL, **data_problems.SQL}
