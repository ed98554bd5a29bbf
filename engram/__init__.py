"""engram: agent-memory analytics and text-corpus operators on PySpark DataFrames."""
