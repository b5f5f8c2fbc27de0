"""marketloom: product and price intelligence over stored web pages, on Spark."""

__version__ = "0.1.0"
