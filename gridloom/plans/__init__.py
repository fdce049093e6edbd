"""Queries over the standard tables; importing this package registers them."""

from . import accounts, assets, bayts, brdf, catalog, change, clouds, collections, design, expressions, fits, histograms, learning, neighbourhoods, recipes, sampling, series, sinks, sources, streams

__all__ = [
    "accounts", "assets", "bayts", "brdf", "catalog", "change", "clouds", "collections", "design", "expressions", "fits", "histograms", "learning", "neighbourhoods", "recipes", "sampling", "series", "sinks", "sources", "streams",
]
