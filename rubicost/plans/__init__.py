"""Named queries by subject; importing this package registers them."""

from rubicost.plans import accuracy, attributes, boq, history, ingest, knowledge, pricing, rules, sheets, store, unitrate, usage, viewer, vocabulary, web

__all__ = ["accuracy", "attributes", "boq", "history", "ingest", "knowledge", "pricing", "rules", "sheets", "store", "unitrate", "usage", "viewer", "vocabulary", "web"]
