"""All queries of the library, and the SQL of those that SQL can express."""

from chalkline.plans import access, catalog, drafts, files, ingest, lifecycle, memory, ops, outline, practice, retrieval, sets

MODULES = (retrieval, access, ingest, files, outline, lifecycle, catalog, practice, sets, drafts, memory, ops)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
