"""symdex: code-intelligence and table analytics as PySpark DataFrame programs."""
