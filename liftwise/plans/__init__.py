"""The view and the reports, the catalogue of registered queries, reference SQL and SQL views."""
