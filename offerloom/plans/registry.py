"""All queries by name, with the SQL they are checked against."""

from offerloom.plans import advice_plans, control_plans, frame_plans, ingest_plans, journal_plans, rating_plans, record_plans, report_plans, settings_plans, stream_plans, sync_plans  # noqa: F401
from offerloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
