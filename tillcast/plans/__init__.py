"""Plans that compose the operators: features, forecast model, reports."""
