"""DataFrame operators: joins, cleaning, imputation, key resolution, aggregates, reports."""
