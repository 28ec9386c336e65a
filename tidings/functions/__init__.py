"""Column expressions. All native to Spark except the HTML parser in ``html``."""
