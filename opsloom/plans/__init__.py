"""Plan building blocks shared by the operators: skew-safe windows, quantiles, closures, predicates."""
