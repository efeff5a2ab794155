"""Strataline: timelines, hierarchies and training-data operators on PySpark."""
