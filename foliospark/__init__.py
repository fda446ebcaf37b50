"""A PySpark engine for document layouts: blocks, pages, documents."""
