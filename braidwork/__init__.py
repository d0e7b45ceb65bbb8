"""braidwork: a PySpark engine that matches, ranks and audits text documents."""

__version__ = "0.1.0"
