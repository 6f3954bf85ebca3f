"""Queries over the driver's tables, and the SQL that checks them."""

from crewspark.plans import assembly, billing, capacity, columns, documents, extraction, lists, marks, planning, predicates, production, products, room_sources, rules, site_texts, streams, takeoff, workload
from crewspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "assembly", "billing", "capacity", "columns", "documents", "extraction", "lists", "marks", "planning", "predicates", "production", "products", "room_sources", "rules", "site_texts", "streams", "takeoff", "workload"]
