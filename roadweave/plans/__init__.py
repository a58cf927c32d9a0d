"""Registered queries: operators applied to views of the driver's tables, each with its SQL twin."""
