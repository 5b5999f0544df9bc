"""Learning analytics on PySpark: survey, quiz and page-view data to scores and models."""

__version__ = "0.1.0"
