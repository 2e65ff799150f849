"""Domain plans built from the operators: features, screening, catchments, scenarios, serving."""
