"""riskflow: payment-fraud analytics as Spark DataFrame jobs and streams."""
