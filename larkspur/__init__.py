"""A PySpark engine for vacancy data: extraction, screening, linkage, search and dashboards over DataFrames."""
