"""Queries as metadata: parsing, classification, join trees and layers.  No Spark here."""
