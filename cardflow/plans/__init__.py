"""Composite flows: onboarding, fraud screen, ledger, order flow, lifecycle."""
