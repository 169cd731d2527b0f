"""Verification of extracted document records against their source text, on Spark."""

from docproof.plans.verify import recheck_edited, verify_documents
from docproof.operators.rules import validate

__all__ = ["recheck_edited", "validate", "verify_documents"]
