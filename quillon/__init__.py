"""Feature analytics engine on PySpark: declarative operators that leave execution to Catalyst."""
