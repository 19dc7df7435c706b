"""Registered queries, grouped as in the survey."""

import importlib

from barwright.plans.registry import CATALOG

for _module in ["cat_windows", "cat_signals", "cat_ledger", "cat_sources", "cat_study", "cat_ops", "cat_forecast", "cat_learning", "cat_reliability"]:
    importlib.import_module(f"barwright.plans.{_module}")

__all__ = ["CATALOG"]
