"""Kernels bound to tables: the driver's tables and the survey's fact tables."""
