"""Column functions: everything here stays in the JVM unless its docstring says otherwise."""
