"""Readers of images, archives, settings and character sets."""
