"""Whole-job plans put together from the operators."""
