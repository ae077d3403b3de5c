"""Operators on images, boxes and sequences."""
