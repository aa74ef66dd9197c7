"""Windows, online estimators, versioned models."""
