"""Column expressions. All are built-in Spark functions, safe under ANSI mode."""
