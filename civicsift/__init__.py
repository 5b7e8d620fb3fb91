"""Community-text toxicity analytics as PySpark DataFrame operators."""
