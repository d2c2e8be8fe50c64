"""Style analytics over personal text archives, on Spark."""
