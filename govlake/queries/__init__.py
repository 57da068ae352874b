"""Named queries over the fixture tables, each with DuckDB SQL for the same rows."""

from govlake.queries import domain, meta, relational, service

QUERIES = relational.REGISTRY.queries | domain.REGISTRY.queries | meta.REGISTRY.queries | service.REGISTRY.queries
ORACLE_SQL = relational.REGISTRY.sql | domain.REGISTRY.sql | meta.REGISTRY.sql | service.REGISTRY.sql
