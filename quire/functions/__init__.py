"""Scalar rules over texts and colours."""
