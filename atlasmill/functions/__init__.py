"""Column builders: text, scoring, JSON, geometry and number formats. Each returns an expression, none runs a job."""
