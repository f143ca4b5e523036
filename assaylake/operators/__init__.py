"""The operators: names, assembly, scoring, quality control, comparison, calibration, maps."""
