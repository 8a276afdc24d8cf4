"""Compositions: recognition pipelines, evaluation runs and the driver's queries."""
