"""Spark-native text-localization pipelines: catalogs, audits, leases, validation, templates and write-back."""

__version__ = "0.1.0"
