"""Aircraft surveillance analytics (Mode S / ADS-B) as Spark DataFrame operators."""

__version__ = "0.1.0"
