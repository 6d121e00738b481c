"""File inventories and the evidence attached to them, and training-data operators, over Spark."""

__version__ = "0.2.0"
