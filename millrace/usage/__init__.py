"""Metering, usage summaries, prices, credits and quotas for all tenants at once."""
