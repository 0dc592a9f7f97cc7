"""Rain, terrain and flood-exposure analytics as PySpark DataFrame operators."""
