"""epochlens: a Spark engine for source-risk analytics over trees of C and C++ text."""
