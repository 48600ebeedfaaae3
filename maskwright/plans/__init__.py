"""Registered queries."""

from . import more as more  # registers its queries beside those of ``queries``
