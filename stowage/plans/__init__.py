"""Catalogue jobs: scan, dedupe, organize, ledger, rollback, report."""
