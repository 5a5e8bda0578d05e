"""All registered queries. Importing this module registers every plan module."""

from __future__ import annotations

from tabletwin.plans import compare_plans, contract_plans, fd_plans, fit_plans, io_plans, profile_plans, request_plans, synth_plans  # noqa: F401
from tabletwin.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
