from . import action_queries, catalog_queries, dataset_queries, graph_queries, report_queries, sequence_queries, session_queries, source_queries  # noqa: F401
