"""Column expressions. Every function takes and returns ``Column`` and stays inside codegen."""
