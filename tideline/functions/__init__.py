"""Column expressions that Spark lacks, composed of those it has."""
