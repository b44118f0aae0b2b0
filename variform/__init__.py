"""variform: variant analytics on PySpark (lazy DataFrame-to-DataFrame operators)."""

__version__ = "0.1.0"
