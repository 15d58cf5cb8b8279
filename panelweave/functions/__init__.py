"""Column expressions and small DataFrame primitives shared by the operators."""
