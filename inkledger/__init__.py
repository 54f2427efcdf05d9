"""Ledger extraction, fusion and scoring as Spark jobs."""
