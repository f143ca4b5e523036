"""Shared statistics: distributed order statistics, column expressions, numpy kernels."""
