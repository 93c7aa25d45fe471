"""quillspark: a Spark-first engine that turns loose documents into typed, reviewed records."""

__version__ = "0.1.0"
