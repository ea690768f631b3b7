"""quillmark: a PySpark-native engine for social-post analytics and corpus preparation."""

__version__ = "0.1.0"
