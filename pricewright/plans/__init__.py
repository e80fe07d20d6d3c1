"""Registered queries; importing this package fills the registry."""

from . import catalog_queries, completed_queries, flow_queries, matching_queries, metrics_queries, monitoring_queries, offer_queries, publish_queries, series_queries, list_queries, stream_queries, title_queries, tree_queries, whole_queries  # noqa: F401
