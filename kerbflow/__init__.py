"""kerbflow: pickup-demand analytics written as Spark DataFrame operators."""
