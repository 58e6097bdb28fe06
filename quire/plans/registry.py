"""Queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from quire.plans import assembly_queries, blueprint_queries, chain_queries, content_queries, detector_queries, fact_queries, flow_queries, form_queries, formpage_queries, lattice_queries, matching_queries, ocr_queries, page_queries, payload_queries, raster_queries, report_queries, rule_queries, semantic_queries, table_queries, wording_queries

FLAGSHIP = "relationship_edges"
_ALL = (page_queries, content_queries, table_queries, form_queries, rule_queries, ocr_queries, formpage_queries, semantic_queries, blueprint_queries, detector_queries, flow_queries, fact_queries, payload_queries, wording_queries, matching_queries, report_queries, raster_queries, lattice_queries, assembly_queries, chain_queries)
QUERIES = {name: query for m in _ALL for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _ALL for name, sql in m.ORACLES.items()}
