"""Part of quillspark, a PySpark-native document-intelligence engine."""
