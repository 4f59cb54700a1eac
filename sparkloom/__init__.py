"""sparkloom: analytics operators written as PySpark DataFrame plans."""
