"""Panel operators: calendar and joins, features, standardisation, retrieval, distributions, stress, validation."""
