"""Scan, scrub, restore and rate documents for secrets and personal data, on Spark."""

from inkblot.plans.scrub import placed_table, scan, scrub, scrub_scanned, vault_table
from inkblot.rules import CustomRule, ScanConfig

__all__ = ["CustomRule", "ScanConfig", "placed_table", "scan", "scrub", "scrub_scanned", "vault_table"]
